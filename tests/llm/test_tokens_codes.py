"""SentencePiece agenda, cross-tokenizer alignment and product codes: the libraries and brute force."""

import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.normalizers import Lowercase

from graphloom.llm import byte_pairs as B
from graphloom.llm import packing
from graphloom.llm import product_codes as C
from graphloom.llm import sentence_pieces as S
from graphloom.llm import token_alignment as A

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "e", "th", "▁", " ", "  ", "\n", "\0", "é", "é", "１", "漢字", "ß", "👍🏽", "<s>", "<0x41>", "<|endoftext|>", "the ", "ing", "\t", "ا", "한", "'s", "..", " ", "Ⅷ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def odd_texts(n, seed, longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randint(0, longest))) for _ in range(n)]


# SentencePiece


def test_agenda_equals_library(library):
    own = S.codec(PIECES)
    texts = odd_texts(3000, 1) + ["", " ", "   x", "x   ", "z" * 5000, "aGVsbG8gd29ybGQ" * 500, "word " * 3000, "\n" * 100]
    ids = [i.tolist() for i in own.encode(texts)]
    assert ids == library.encode(texts)
    assert [own.decode(i) for i in ids] == [library.decode(i) for i in ids]


def test_matrix_and_heap_agree():
    own, rng = S.codec(PIECES), random.Random(3)
    words = ["▁" + "".join(rng.choices("etaoinshrdlu.,'xyz", k=rng.randint(1, 30))) for _ in range(3000)]
    assert [np.frombuffer(x, "<i4").tolist() for x in own.agendas(words)] == [own.agenda(w) for w in words]


def test_pairs_share_slots_and_words_are_cut_once():
    own, rng = S.Codec(PIECES), np.random.default_rng(4)
    keys = own.pair_keys[:-1]
    assert (own.slots == S.SHARED).sum() > 0  # some pairs share a slot, and are found all the same
    rank, piece = own._pairs((keys // own.width).astype(np.int32), (keys % own.width).astype(np.int32))
    assert (rank == own.pair_rank[:-1]).all() and (piece == own.pair_piece[:-1]).all()
    left, right = rng.integers(-1, own.width, (2, 200_000), dtype=np.int32)
    known = np.isin(left.astype(np.int64) * own.width + right, keys) & (left >= 0) & (right >= 0)
    assert (np.isfinite(own._pairs(left, right)[0]) == known).all()

    class Counted:
        calls, pattern = 0, own.stretch

        def findall(self, text):
            self.calls += 1
            return self.pattern.findall(text)

    own.stretch = counted = Counted()
    own.encode(["made upp wordds, onlyy", "a\nb"])
    assert counted.calls == 1  # only for what holds a cut


def test_decode_any_ids(library):
    own, rng = S.codec(PIECES), random.Random(5)
    for _ in range(3000):
        ids = [rng.randrange(300) for _ in range(rng.randint(0, 8))] + [rng.randrange(32000) for _ in range(3)]
        rng.shuffle(ids)
        assert own.decode(ids) == library.decode(ids)


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"\x12\x02\x18\x01")  # a unigram model
    with pytest.raises(ValueError, match="BPE"):
        S.Codec(str(tmp_path / "m"))


def test_encode_decode_rows(make, library):
    rows = [(1, None, "p"), (None, "", "q"), (1, " two  words\n", None), (1, " two  words\n", None), (2, "▁ " + "long " * 20000, "r")]
    df = S.encode_decode(make(rows, "doc_id long, text string, `a.b` string"), PIECES)
    got = [(r.doc_id, r.text, r["a.b"], r.pieces.ids, r.pieces.decoded) for r in df.collect()]
    want = [(*r, ids := library.encode(r[1] or ""), library.decode(ids)) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    digest = {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in S.digests(make(rows, "doc_id long, text string, pieces string"), PIECES).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert digest == {(len(w[3]), sha(",".join(map(str, w[3]))), sha(w[4])) for w in want}
    assert S.digests(make([], "doc_id long, text string"), PIECES).count() == 0


def test_a_difference_fails_the_batch():
    own = S.Codec(PIECES)
    own.encode(odd_texts(200, 9) + [" two  words", "x\n▁▁y"])
    own.pair_rank[own.pair_piece == own.ids["▁th"]] = np.inf
    with pytest.raises(RuntimeError, match="differ"):
        own.encode(["thorn"])


# Byte pairs


def test_byte_pairs_equal_the_tokenizers_library():
    own, tok, plain = B.BytePairs(BYTES), Tokenizer.from_file(BYTES), Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    run = " " * 1_200_000  # the pattern's look-ahead took more stack than there is
    texts = odd_texts(1000, 11) + [run, f"a{run}b", f"{run}\nb", f"{run}<|endoftext|>{run}x<|endoftext|>", "\u2003" * 20_000 + "'s", "\x1c" * 20_000 + "a", "a" * 300_000]
    texts.append("".join(f"a{chr(c)}{chr(c)} {chr(c)}1" for c in [*range(0xD800), *range(0xE000, 0x110000, 7)]))
    for text in texts:
        assert own.encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text[:40])
        assert own.plain(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text[:40])


def test_new_words_cost_a_fraction_of_the_library():
    """Each new word was merged alone, in a call of its own: 0.4 of the library's time for whole texts."""
    rng, ids = random.Random(12), packing._Ids(BYTES)
    texts = [" ".join("".join(rng.choices(["th", "er", "on", "an", "re", "lich"], k=5)) for _ in range(500)) for _ in range(150)]

    def took(run):
        start = time.process_time()
        for text in texts:
            run(text)
        return time.process_time() - start

    packing.token_bytes("a", ids)
    own = took(lambda t: packing.token_bytes(t, ids))
    assert own < 0.3 * took(lambda t: ids.tokenizer.encode(t, add_special_tokens=False).ids)


def test_other_byte_vocabularies_go_through_the_library(tmp_path):
    tok = Tokenizer.from_file(BYTES)
    tok.normalizer = Lowercase()
    tok.save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError, match="plain"):
        B.BytePairs(str(tmp_path / "t.json"))
    got = packing.token_bytes("Two WORDS", packing._Ids(str(tmp_path / "t.json")))
    assert np.frombuffer(got, "<u4").tolist() == [*tok.encode("two words", add_special_tokens=False).ids, 0]


# Alignment


def plain_alignment(docs):
    """Brute force with the libraries: all token pairs, byte by byte."""
    a_tok, b_tok = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_tok.encode_special_tokens = True
    own = A.aligner(BYTES, PIECES)
    per_doc, count = [], Counter()
    for key, text in docs:
        groups, links = [], Counter()
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        ok = bool(text) and b"".join(own.a_bytes[i] for i in a) == b"".join(own.b_bytes[i] for i in b) == (" " + text).encode()
        a, b = (a, b) if ok else ([], [])
        i = j = at_a = at_b = 0
        ga, gb = [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                ga.append(a[i])
                at_a += len(own.a_bytes[a[i]])
                i += 1
            else:
                gb.append(b[j])
                at_b += len(own.b_bytes[b[j]])
                j += 1
            if at_a == at_b:
                groups.append((ga, gb))
                links.update((x, y) for x in ga for y in gb)
                ga, gb = [], []
        per_doc.append((key, len(a), len(b), groups, links))
        count.update(links.keys())
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for key, n_a, n_b, groups, links in per_doc:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for p, n in links.items() if count[p] == top[p[0]])
        out.append((key, n_a, n_b, len(groups), sum(links.values()), best, sum(n * count[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("popular", [A.POPULAR, 5, 0])
def test_alignment_equals_brute_force(make, monkeypatch, popular):
    monkeypatch.setattr(A, "POPULAR", popular)
    texts = odd_texts(150, 7) + ["the same text"] * 40 + [None, "", "  ", "a▁b", "<|endoftext|> here", "word and " * 3000, "é" * 3000]
    docs = [(None if k % 50 == 0 else k % 120, t) for k, t in enumerate(texts)]
    got = A.alignment(make([(*d, "x") for d in docs], "doc_id long, text string, sha string"), BYTES, PIECES).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_alignment(docs)


def test_alignment_of_nothing(make):
    assert A.alignment(make([], "doc_id long, text string"), BYTES, PIECES).count() == 0
    assert [tuple(r) for r in A.alignment(make([(3, None)], "doc_id long, text string"), BYTES, PIECES).collect()] == [(3, 0, 0, 0, 0, 0, 0, "")]


# Product codes


@pytest.mark.parametrize("spread", [1, 3, 50, 100000])
def test_gnat_finds_the_first_nearest(spread):
    rng = np.random.default_rng(spread)
    for n in (1, 2, 9, 64, 300):
        entries, queries = (rng.integers(-spread, spread + 1, (m, 4)) for m in (n, 400))
        queries[:50] = entries[rng.integers(0, n, 50)]
        squares = ((queries[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
        row, best = C.Gnat(entries).nearest(queries)
        assert (best == squares.min(1)).all() and (row == squares.argmin(1)).all()


def test_gnat_prunes(monkeypatch):
    rng = np.random.default_rng(1)
    entries = np.concatenate([rng.integers(0, 50, (32, 4)) + 10_000 * k for k in range(4)])
    tree, seen = C.Gnat(entries), [0]
    real = C._squares
    monkeypatch.setattr(C, "_squares", lambda a, b: seen.__setitem__(0, seen[0] + len(a) * len(b)) or real(a, b))
    tree.nearest(entries)
    assert seen[0] < 0.6 * len(entries) ** 2


def plain_codes(rows, parts=C.PARTS, entries=C.ENTRIES, rounds=C.ROUNDS):
    fine = [(k, v, lab) for k, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    size = -(-max([len(v) for _, v, _ in fine] + [1]) // parts) * parts
    ints = [[int(np.floor(x * 256)) for x in v] + [0] * (size - len(v)) for _, v, _ in fine]
    cut = [[i[k * size // parts : (k + 1) * size // parts] for k in range(parts)] for i in ints]
    order = sorted(range(len(fine)), key=lambda i: (fine[i][0] is None, fine[i][0] or 0, fine[i][1]))[:entries]
    books = [[cut[i][k] for i in order] for k in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda k, v: min(range(len(books[k])), key=lambda e: (distance(v, books[k][e]), e))
    for _ in range(rounds):
        for k in range(parts):
            took = defaultdict(list)
            for c in cut:
                took[near(k, c[k])].append(c[k])
            books[k] = [[sum(x) // len(took[e]) for x in zip(*took[e], strict=True)] if e in took else b for e, b in enumerate(books[k])]
    found = [[near(k, c[k]) for k in range(parts)] for c in cut]
    errors = [sum(distance(c[k], books[k][f[k]]) for k in range(parts)) for c, f in zip(cut, found, strict=True)]
    by_label = Counter()
    for (_, _, lab), e in zip(fine, errors, strict=True):
        by_label[lab] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((k, "".join(f"{x:02x}" for x in f), e, by_label[lab], sha) for (k, _, lab), f, e in zip(fine, found, errors, strict=True)), key=repr)


@pytest.mark.parametrize("broadcast", [C.BROADCAST_LABELS, 0])
def test_codes_equal_brute_force(make, monkeypatch, broadcast):
    monkeypatch.setattr(C, "BROADCAST_LABELS", broadcast)
    rng, nan = random.Random(2), float("nan")
    rows = [(k, [float(np.float32(rng.gauss(0, 0.1))) for _ in range(32)], rng.choice([1, 2, None])) for k in range(200)]
    rows += [rows[0], rows[0], (None, rows[3][1], 1), (300, None, 1), (301, [nan] * 32, 1), (302, [None] * 32, 1), (303, [float("inf")] * 32, 2), (304, [0.5, -0.5], 2), (305, [], None), (306, [0.0] * 32, 9)]
    df = make([(*r, "e") for r in rows], "vec_id long, embedding array<float>, label int, code string")
    assert sorted((tuple(r) for r in C.product_codes(df).collect()), key=repr) == plain_codes(rows)


def test_codes_of_few_rows_and_large_components(make):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(5, [0.25] * 16, None), (2, [1.0] * 16, None)]
    assert sorted(tuple(r) for r in C.product_codes(make(rows, schema)).collect()) == plain_codes(rows)
    assert C.product_codes(make([], schema)).count() == 0 and C.product_codes(make([(1, None, 1)], schema)).count() == 0
    with pytest.raises(ValueError, match="large"):
        C.product_codes(make([(1, [1e30] * 16, 1)], schema))
