"""WARC, page extraction, PII, packing and the permutation index: round trips and brute force."""

import base64
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graphloom.llm import html_extract as H
from graphloom.llm import packing as K
from graphloom.llm import permutation_index as P
from graphloom.llm import pii as I
from graphloom.llm import warc as W

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# WARC


def records(n=6):
    return [W.record_bytes(i, f"http://h/{i}", b"payload WARC/1.1\r\n%d" % i * 40, None, False, "2025-01-01T00:00:00Z") for i in range(n)]


def names(data):
    return [x["fields"]["warc-record-id"] for k, _, _, x in W.salvage(data) if k == "record"]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_all_but_the_damaged_record(packed):
    rec = records()
    parts = [W.member(r) + b"\0" if packed else r for r in rec]
    whole = b"".join(parts)
    assert names(whole) == [f"<urn:page:{i}>" for i in range(6)]
    rng, begin = random.Random(2), len(parts[0]) + len(parts[1])
    for _ in range(25):
        at = begin + rng.randrange(10 if packed else 9, len(parts[2]) - 12)
        bad = bytearray(whole)
        bad[at] ^= 1 << rng.randrange(8)
        found = list(W.salvage(bytes(bad)))
        got = [x["fields"].get("warc-record-id") for k, _, _, x in found if k == "record"]
        assert [g for g in got if g != "<urn:page:2>"][:2] == ["<urn:page:0>", "<urn:page:1>"] and got[-3:] == [f"<urn:page:{i}>" for i in (3, 4, 5)]
        ends = [b for _, b, _, _ in found] + [len(bad)]
        assert all(e == b for (_, _, e, _), b in zip(found, ends[1:], strict=True)) and ends[0] == 0  # every byte is accounted for


def test_salvage_of_cut_and_foreign_bytes():
    rec = records()
    cut = rec[0] + rec[1][: len(rec[1]) // 2] + rec[2] + b"noise" + W.member(rec[3]) + b"\0" + rec[4][:-1]
    assert names(cut) == ["<urn:page:0>", "<urn:page:2>", "<urn:page:3>"]
    assert list(W.salvage(b"")) == [] and [k for k, *_ in W.salvage(b"\x1f\x8b\x08zzz")] == ["gap"]
    whole = zlib.compressobj(6, zlib.DEFLATED, 31)
    one = whole.compress(rec[0] + b"junk" + rec[1]) + whole.flush()
    assert [k for k, *_ in W.salvage(one)] == ["record", "gap", "record"]


def test_warc_round_trip(make, spark):
    rows = [(3, "http://a/1", "<p>same</p>"), (1, None, "<p>same</p>"), (2, "http://a/\r\n2", None), (9, "u", ""), (4, "http://é", "ä" * 50000), (None, "x", "<p>same</p>"), (1, "again", "<p>same</p>")]
    got = sorted((tuple(r) for r in W.round_trip(make([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")).collect()), key=repr)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {"<p>same</p>": 1, "": 2, "ä" * 50000: 4}
    want = []
    for i, _, t in rows:
        f = first[t or ""]
        want.append((i, len((t or "").encode()), digest(t), "response" if i == f else "revisit", None if i == f else f))
    assert got == sorted(want, key=repr)
    assert W.round_trip(make([], "page_id long, url string, html string")).count() == 0


def test_small_payloads_are_not_revisited(make, spark, tmp_path):
    W.write_warc(make([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string"), str(tmp_path / "w"), min_revisit_bytes=5)
    got = {r.record_id: r.record_type for r in W.read_warc(spark, str(tmp_path / "w")).collect()}
    assert got == {"<urn:page:1>": "response", "<urn:page:2>": "response", "<urn:page:3>": "response", "<urn:page:4>": "revisit"}


def test_a_broken_member_keeps_its_whole_records(make, spark, tmp_path):
    rec = records(5)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = pack.compress(b"".join(rec)) + pack.flush()
    cut = member[:-12] + W.member(rec[0]) + b"\0"
    found = list(W.salvage(cut))
    got = [x["fields"]["warc-record-id"] for k, _, _, x in found if k == "record"]
    assert got[:4] == [f"<urn:page:{i}>" for i in range(4)] and got[-1] == "<urn:page:0>"
    assert any(k == "gap" and b == 0 for k, b, _, _ in found) and found[-1][2] == len(cut)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc.gz").write_bytes(cut)
    assert W.log_gaps(W.read_warc(spark, str(tmp_path / "a")), str(tmp_path / "gaps")) == 1
    gap = spark.read.parquet(str(tmp_path / "gaps")).first()
    assert gap.begin == 0 and gap.end == len(member) - 12 and gap.reason == "broken gzip member"


def test_archives_are_bounded_by_bytes(make, spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "u", "".join(rng.choice("abcdefgh") for _ in range(20_000))) for i in range(40)]
    W.write_warc(make(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"), archive_bytes=50_000)
    sizes = [f.stat().st_size for f in (tmp_path / "w").rglob("part-*")]
    assert len(sizes) > 4 and max(sizes) < 60_000 and W.read_warc(spark, str(tmp_path / "w")).where("kind = 'record'").count() == 40


# Pages


def page(i, body, extra=""):
    return f"<html><head><title>t</title><style>p{{}}</style><script>var x='</p>';</script></head><body><nav><ul><li>Home</li><li>n{i}</li></ul></nav><div class='ad'>buy {i}</div><article><h1>Title {i}</h1>{body}</article><aside class=sidebar>s</aside><div id='comments'><p>nice {i}</p></div>{extra}<footer>&copy; f{i}</footer></body></html>"


def test_main_text(make):
    rows = [(i, f"http://h.example/{i}", page(i, f"<p>One &amp; two<br>  three {i}<p><b>open {i} <i>tag</i><ul><li>x<li>y</ul>")) for i in range(5)]
    rows += [(10, None, None), (11, "odd", ""), (12, "http://h.example/12", "<div><p>bare"), (13, "http://h.example/0", rows[0][2])]
    got = {r.page_id: r for r in H.extract_main_text(make([(*r, "c") for r in rows], "page_id long, url string, html string, text string")).collect()}
    for i in range(5):
        assert got[i].text == f"Title {i}\n\nOne & two three {i}\n\nopen {i} tag\n\nx\n\ny" and got[i].n_chars == len(got[i].text)
    assert got[13].text == got[0].text and got[10].text == "" and got[11].n_chars == 0 and got[12].text == "bare"
    assert H.extract_main_text(make([], "page_id long, url string, html string")).count() == 0


def test_template_without_article(make, monkeypatch):
    rows = [(i, f"http://k/{i}", f"<body><div id=top>Site name</div><div id=body><p>para {i} {'word ' * 30}</p><p>more {i}</p></div><div id=base>Impressum</div></body>") for i in range(6)]
    df = make(rows, "page_id long, url string, html string")
    want = {i: f"para {i} {'word ' * 30}".strip() + f"\n\nmore {i}" for i in range(6)}
    assert {r.page_id: r.text for r in H.extract_main_text(df).collect()} == want
    monkeypatch.setattr(H, "BROADCAST_ENTRIES", 0)  # the way beyond the bound gives the same
    assert {r.page_id: r.text for r in H.extract_main_text(df).collect()} == want
    (one,) = H.deduce_templates(df).collect()
    # body and the three divs are one class with the fixed texts; p is twice on each page, alone of its kind
    assert (len(one.template), len(one.root), len(one.fixed)) == (4, 4, 2)
    assert H.main_text(rows[0][2], set()) != want[0] == H.main_text(rows[0][2], set(one.template), set(one.fixed), one.root)  # the template decides


def test_only_the_template_gives_names_a_meaning(make):
    inner = ["<section class='social-policy'><p>S{0}</p></section>", "<div class='news-alert'><p>N{0}</p></div>", "<h2 id='comment-on-rates'>C{0}</h2>", "<div class='sponsored'><p>told once {0}</p></div>"]
    rows = [(i, f"http://t/{i}", page(i, (inner[i] if i < 4 else "<p>plain {0}</p>").format(i) + f"<div class='share'>tell {i}</div>")) for i in range(9)]
    rows += [(20, "http://alone/", page(20, inner[3].format(20))), (21, "http://wide/", "<div class='content-with-sidebar'><p>The whole story here.</p></div>")]
    got = {r.page_id: r.text for r in H.extract_main_text(make(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].split("\n\n")[1:] for i in range(5)] == [["S0"], ["N1"], ["C2"], ["told once 3"], ["plain 4"]]  # div.share is of the template, and no text
    assert got[20] == "Title 20" and got[21] == "The whole story here."


def test_pages_that_do_not_instantiate_the_template(make):
    rows = [(i, f"http://m/{i}", page(i, f"<p>text {i}</p>")) for i in range(8)] + [(9, "http://m/9", "<table><tr><td><nav>go</nav>odd <i>page</i></table>")]
    got = {r.page_id: r.text for r in H.extract_main_text(make(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "odd page" and got[1] == "Title 1\n\ntext 1"


def test_classes_by_brute_force(make):
    rng = random.Random(8)
    rows = []
    for i in range(14):
        parts = [f"<div class=a>{i}</div>", f"<div class=b>{i}</div>", "<p>same</p>" * (1 + i % 2), f"<span>{i}</span>", f"<ul class=c><li>{i}</ul>" * (i % 3 == 0)]
        if i % 4 == 0:
            rng.shuffle(parts)
        rows.append((i, "http://b/", f"<body>{''.join(parts)}</body>"))
    rows.append((99, "http://b/", rows[0][2]))
    df = make(rows, "page_id long, url string, html string")
    tokens = H._tokens(df).distinct()
    hosts = tokens.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    got = {(r.path, r.text) for r in H.valid_classes(tokens, hosts).collect()}
    pages = {}
    for r in tokens.collect():
        pages.setdefault(r.page, {})[(r.path, r.text)] = (r.place, r.times)
    vectors = {}
    for t in {t for p in pages.values() for t in p}:
        vectors.setdefault(tuple(pages[p].get(t, (0, 0))[1] for p in sorted(pages)), []).append(t)
    want = set()
    for v, members in vectors.items():
        on = [p for p in pages if members[0] in pages[p]]
        orders = {tuple(sorted(members, key=lambda t: pages[p][t][0])) for p in on}
        if len(on) >= H.MIN_PAGES and len(members) >= H.MIN_TOKENS and len(orders) == 1:
            want |= set(members)
    assert got == want and want and len(pages) == 14


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "x", "<i><p>" + "<b>" * 50_000 + "</i>" * 50_000, "<ul><li>" + "<x>" * 50_000 + "<li>" * 50_000, '<a "' * 100_000, '<a ">' * 50_000, "<svg>" * 50_000, "<" * 200_000])
def test_time_grows_with_the_page(html):
    begin = time.process_time()
    H.main_text(html, None)
    assert time.process_time() - begin < 20


def test_odd_markup():
    cases = {
        "<p>x <svg a='1'/>y<title-bar>z</title-bar> w</p><svg><text>no</text></svg>": "x y\n\nz\n\nw",
        "<p title='1>2'>ok</p>": "ok", "x < y and z > w": "x < y and z > w", "<style>unclosed <p>no": "", "<p>a<p>b<ul><li>c<li>d</ul>": "a\n\nb\n\nc\n\nd",
        "<script>var a='<p>'</script>t&eacute;xt &#x41;": "téxt A", "<!-- <p>no</p> -->yes<!-- open": "yes",
    }
    assert {k: H.main_text(k, None) for k in cases} == cases


def test_copies_are_no_template(make):
    rows = [(i, "http://c/", page(0, "<p>same article</p>")) for i in range(20)] + [(50, "http://c/x", page(1, "<p>other</p>"))]
    got = {r.page_id: r.text for r in H.extract_main_text(make(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title 0\n\nsame article" and got[50] == "Title 1\n\nother"


# Personal data


def test_pii(make):
    text = "Mrs Anna Smith (a.b@mail.example.com, A.B@MAIL.EXAMPLE.COM) and Mr. Smith; 4111 1111 1111 1111, 4111-1111-1111-1111, +1 (522) 555-2427, 10.2.3.4 at 8.8.8.8. 123-45-6789 г-н Иван Петров"
    rows = [(1, text, 0), (2, None, 1), (3, "", 2), (4, "nothing here", 3), (4, "mail a.b@mail.example.com", 4), (6, "x " * 50000 + "a.b@mail.example.com", 5)]
    df = make(rows, "doc_id long, text string, rid int")
    out = I.replace_pii(df, "k")
    got = sorted(out.collect(), key=lambda r: r.rid)
    one = got[0].text
    assert out.columns == ["doc_id", "text", "rid", "n_entities"] and got[0].n_entities == 3 + 2 + 2 + 1 + 2 + 1  # names, mail, cards, phone, addresses, SSN
    for gone in ("Smith", "Anna", "a.b@", "A.B@", "4111 1111", "522", "10.2.3.4", "8.8.8.8", "123-45", "Иван", "Петров"):
        assert gone not in one
    words = one.replace(",", " ").replace(";", " ").split()
    assert words[0] == "Mrs" and words[1].endswith("a") and words[2] == words[words.index("Mr.") + 1]
    mails = [w.strip("()") for w in words if "@" in w]
    assert mails[0].upper() == mails[1] and got[4].text == f"mail {mails[0]}" and got[5].text.endswith(mails[0])
    cards = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", one)
    assert len(cards) == 2 and cards[0].replace(" ", "") == cards[1].replace("-", "") and cards[0][0] == "4" and luhn(cards[0])
    assert [r.text for r in got[1:4]] == [None, "", "nothing here"] and [r.n_entities for r in got[1:4]] == [0, 0, 0]
    assert I.replace_pii(df.where("rid = 0"), "other").first().text != one
    assert I.replace_pii(make([], "doc_id long, text string"), "k").count() == 0


def luhn(number):
    digits = [int(d) for d in re.sub(r"\D", "", number)][::-1]
    return sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(digits)) % 10 == 0


def replaced(make, text, key="k"):
    return I.replace_pii(make([(1, text)], "doc_id long, text string"), key).first().text


def test_names_are_replaced_wherever_the_document_has_them(make):
    got = replaced(make, "Mrs Anna Smith met Smith. Anna Smith called SMITH; a Blacksmith. Dr. Jane Roe. г-н Иван Петров, Петров.").split()
    assert got[4].rstrip(".") == got[2] and got[5:7] == got[1:3] and got[8] == got[2].upper() + ";" and got[10] == "Blacksmith."
    assert "Jane" not in got and re.fullmatch("[а-яА-Я]+", got[-3]) and got[-1] == got[-2].replace(",", ".")


def test_numbers_keep_country_range_and_check_digits(make):
    got = replaced(make, "+44 20 7946 0958|020 7946 0958|01 23 45 67 89|+33 1 23 45 67 89|+49 30 123456|(522) 555-2427|+15225552427").split("|")
    assert got[0].startswith("+44 ") and got[1] == "0" + got[0][4:] and got[2][0] == "0" and got[3] == "+33 " + got[2][1:] and got[4].startswith("+49 ")
    assert re.sub(r"\D", "", got[6])[1:] == re.sub(r"\D", "", got[5]) and got[6].startswith("+1")
    shapes = lambda x: re.sub(r"\d", "0", x)
    assert [shapes(g) for g in got] == ["+00 00 0000 0000", "000 0000 0000", "00 00 00 00 00", "+00 0 00 00 00 00", "+00 00 000000", "(000) 000-0000", "+00000000000"]
    ips = replaced(make, "8.8.8.8 172.16.3.4 192.168.1.7 127.0.0.1 169.254.9.9 fe80::1 2001:db8::8a2e:370:7334 std::vector 12:30:45").split()
    private = re.match(r"172\.(\d+)\.", ips[1])
    assert int(ips[0].split(".")[0]) in I.PUBLIC and 16 <= int(private[1]) <= 31 and ips[2].startswith("192.168.") and ips[3].startswith("127.") and ips[4].startswith("169.254.")
    assert ips[5].startswith("fe80::") and "2001:db8" not in ips[6] and ips[7:] == ["std::vector", "12:30:45"]
    cards = replaced(make, "378282246310005|3782 822463 10005|1234567890123|12345678901234").split("|")
    assert luhn(cards[0]) and cards[0] != "378282246310005" and cards[1].replace(" ", "") == cards[0] and cards[2:] == ["1234567890123", "12345678901234"]
    iban = replaced(make, "GB82 WEST 1234 5698 7654 32")
    plain = iban.replace(" ", "")
    assert iban != "GB82 WEST 1234 5698 7654 32" and plain[:2] == "GB" and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_no_pattern_breaks_on_long_texts(make):
    texts = ["u@" + "b." * 20_000 + "com", "a@" * 100_000, "+1" * 100_000, "0 " * 100_000, "1:" * 60_000, ":" * 200_000, "A" * 100_000 + " GB82" * 20_000, "é" * 300_000 + "Dr Xx" * 20_000]
    got = I.replace_pii(make(list(enumerate(texts)), "doc_id int, text string"), "k").collect()
    assert all(len(r.text) >= len(texts[r.doc_id]) * 0.9 for r in got) and len(got) == len(texts)


def test_clashing_names_and_repeated_rows(make):
    rows = [(1, "a@b.example.com", "x", "y", 3), (1, "a@b.example.com", "x", "y", 3), (2, "clean", None, None, None)]
    df = make(rows, "doc_id long, text string, n_entities string, row string, hits int")
    out = I.replace_pii(df, "k")
    got = sorted(out.collect())
    assert out.columns == ["doc_id", "text", "row", "hits", "n_entities"] and got[0] == got[1] and got[2].text == "clean" and got[0].n_entities == 1


def test_texts_without_a_match_are_not_shuffled(make, spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=20_000))) for i in range(200)] + [(200, "mail a@b.example.com"), (201, "no card 1234567890123"), (202, None)]
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def shuffled():
        bus.waitUntilEmpty()
        return store.executorSummary("driver").totalShuffleWrite()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with more replacements than a broadcast holds
    try:
        before = shuffled()
        got = {r.doc_id: (r.text, r.n_entities) for r in I.replace_pii(make(rows, "doc_id long, text string"), "k").collect()}
        assert shuffled() - before < 500_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == len(rows) and got[200][0] != rows[200][1] and got[200][1] == 1
    assert all(got[i] == (t, 0) for i, t in rows if i != 200)


def test_surrogates_are_distinct_and_new(make):
    entities = make([("surname", n) for n in ("li", "lu", "ma", "mi", "mu", "na", "no", "ba", "be", "bo")] + [("ssn", f"12345678{i}") for i in range(10)], "type string, canon string")
    got = I.assign_surrogates(entities, "k").collect()
    assert len({(r.type, r.surrogate) for r in got}) == 20 and not {(r.type, r.surrogate) for r in got} & {(r.type, r.canon) for r in got}
    clash = lambda key: F.when(F.col("attempt") == 0, F.lit("same")).otherwise(F.concat("canon", F.lit("!"), F.col("attempt").cast("string")))
    assert len({r.surrogate for r in I.assign_surrogates(entities.where("type = 'ssn'"), "k", clash).collect()}) == 10


# Packing


def test_packing_is_whole_and_gapless(make):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta,", "Straße", "x\ny", "don't", "42", "½", "漢字"]) for _ in range(rng.choice([0, 3, 90, 700, 2000]))) for _ in range(40)] + [None, "", "<|endoftext|>  ok", "w " * 60000]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(None, "null key", "c"), (3, texts[3], "c")]
    got = K.pack(make(rows, "doc_id long, text string, length string"), TOKENIZER, with_ids=True).collect()
    tokenizer, per = Tokenizer.from_file(TOKENIZER), {}
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        per.setdefault(r.doc_id, []).append(r)
    for i, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        pieces = sorted(per[i], key=lambda r: r.start)
        if i == 3:
            assert b"".join(p.ids for p in pieces[::2]) == ids == b"".join(p.ids for p in pieces[1::2])
        else:
            assert b"".join(p.ids for p in pieces) == ids and pieces[0].doc_tokens == len(ids) // 4
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 1024) * 1.1 + 2
    assert K.pack(make([], "doc_id long, text string"), TOKENIZER).count() == 0


def test_patterns_hold_each_item_once():
    rng = random.Random(7)
    for n in (1, 30, 4000):
        histogram = {}
        for _ in range(n):
            k = rng.choice([rng.randint(1, 255), 256, 512, 768])
            histogram[k] = histogram.get(k, 0) + 1
        plan = K.solve_patterns(histogram)
        held = {}
        for copies, pattern in plan:
            assert copies > 0 and sum(k * t for k, t in pattern.items()) <= 1024
            for k, t in pattern.items():
                held[k] = held.get(k, 0) + copies * t
        assert held == histogram
        volume = sum(k * c for k, c in histogram.items()) / 1024
        assert sum(c for c, _ in plan) <= volume * 1.03 + 2
    assert K.solve_patterns({}) == []


def test_ids_on_all_code_points():
    ids = K._ids(TOKENIZER)
    whole = lambda t: np.array([*ids.tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
    for c in [*range(0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x110000, 97)]:
        text = f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}"
        assert K.token_bytes(text, ids) == whole(text), hex(c)
    rng = random.Random(3)
    parts = [" ", "  ", "\n", " \n", "\t", "a", "word", "It's", "'s", "42", "½", "_", "--", "é", "\r\n", "\x0b", "\xa0", "\u2009", "漢字", "😀", "<|endoftext|>", "! ", "...", "\x1c"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert K.token_bytes(text, ids) == whole(text), repr(text)
    long = "ab \n  c" * 9000
    assert K.token_bytes(long, ids) == whole(long)


# Nearest neighbours


def test_nearest_reaches_its_recall(make):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24)).astype("float32")
    x[700:900] = x[700] + rng.normal(size=(200, 24)).astype("float32") * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1000:1100] = x[1000]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = {}
    for r in P.nearest(make(rows, "vec_id long, embedding array<float>, score int")).collect():
        got.setdefault(r.query_id, []).append(r)
    recall, full = [], x.astype(float)
    for q in range(0, 1500, 20):
        score = (full * full[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(1500), -score)) if i != q][:20]
        mine = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and all(r.score == score[r.vec_id] for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        recall.append(len({r.vec_id for r in mine} & set(order)) / 20)
    assert len(got) == 75 and np.mean(recall) >= 0.9
    assert [r.vec_id for r in sorted(got[1000], key=lambda r: r.rank)] == list(range(1001, 1021))  # ties by id


def test_nearest_cases(make):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (20, [nan, 1.0]), (40, [inf, 1.0]), (60, [None, 1.0]), (None, [1.0, 1.0]), (80, [2.0, 1.0]), (5, [1.0]), (1, [0.5, 0.5])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in P.nearest(make(rows, "vec_id long, embedding array<float>")).collect())
    # shorter vectors count as padded with zeros, and rows that repeat an id are candidates of their own
    assert got == [(0, 1, 80, 2.0), (0, 2, 5, 1.0), (0, 3, 1, 0.5), (0, 4, 1, 0.5), (80, 1, 0, 2.0), (80, 2, 5, 2.0), (80, 3, 1, 1.5), (80, 4, 1, 1.5)]
    twice = make([(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r["rank"], r.vec_id, r.score) for r in P.nearest(twice).collect()) == [(1, 20, 0.0), (1, 20, 1.0), (1, 20, 1.0), (2, 20, 0.0), (2, 20, 0.0), (2, 20, 0.0)]
    assert P.nearest(make([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("n", [15, 50, 100, 200, 500])
def test_small_tables_give_whole_results(make, n):
    x = np.random.default_rng(n).normal(size=(n, 32))
    got = {}
    for r in P.nearest(make([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    recall = []
    for q in range(0, n, 20):
        score = (x * x[q]).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(n), -score)) if i != q][:20]
        assert len(got[q]) == len(set(got[q])) == min(20, n - 1)
        recall.append(len(set(got[q]) & set(want)) / len(want))
    assert np.mean(recall) >= 0.9


def test_cards_in_all_groupings_leave_no_digits(make):
    rng = random.Random(4)
    for groups in ((4, 4, 4, 4), (16,), (4, 6, 5), (15,), (4, 4, 4, 4, 3), (13,)):
        for sep in " -":
            digits = [rng.randrange(1, 10) for _ in range(sum(groups) - 1)]
            odd = sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(reversed(digits)))
            digits = "".join(map(str, [*digits, -odd % 10]))
            at, parts = 0, []
            for g in groups:
                parts.append(digits[at : at + g])
                at += g
            got = replaced(make, f"pay {sep.join(parts)} now, or {digits}; call 555-242-7000 555-242-7001")
            assert digits[-4:] not in re.sub(r"\D", "", got.split("call")[0])[len(digits) - 4 : len(digits)] and "242-7000" not in got
            first, second = got.removeprefix("pay ").split("; call")[0].split(" now, or ")
            assert re.sub(r"\D", "", first) == second != digits and re.sub(r"\d", "0", first) == sep.join("0" * g for g in groups)


def test_footrule_gain_by_brute_force():
    rng = np.random.default_rng(1)
    lists = np.array([rng.permutation(9)[:4] for _ in range(12)])
    weights = P.place_weights(lists, 9, 4)
    place = lambda row, p: list(row).index(p) if p in row else 4
    for q in range(3):
        gain = P.footrule_gain(lists[q], weights, 4)
        for v in range(12):
            distance = sum(abs(place(lists[q], p) - place(lists[v], p)) for p in range(9))
            assert gain[v] == 4 * 5 - distance


def test_crowds_of_copies_and_near_copies(make):
    """A third of the rows is one vector and a third a tight crowd: recall holds for all queries, also of the others."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1800, 24))
    x[:600] = x[0]
    x[600:1200] = x[600] + rng.normal(size=(600, 24)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order = rng.permutation(1800)
    x = x[order]
    got = {}
    for r in P.nearest(make([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    recall = []
    for q in range(0, 1800, 20):
        score = (x * x[q]).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(1800), -score)) if i != q][:20]
        recall.append(len(set(got[q]) & set(want)) / 20)
    assert np.mean(recall) >= 0.9 and len(got) == 90
