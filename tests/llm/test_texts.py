"""The text operators against brute force, other libraries, and exact round trips."""

from __future__ import annotations

import base64
import itertools
import random
import re
import time
import unicodedata
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.oracle import connect, difference
from tidelog.llm import formatting, mixing, queries, spam, tokenizer
from tidelog.llm.words import LINK, TAG, page, tokens

PATH = f"{tokenizer.FOLDER}/{tokenizer.VOCABULARY}"
ODD = ["", " ", "\n\n x", "<|endoftext|>", "\0\1", "a" * 20_000, "é" * 3000, "👨‍👩‍👧🔥", "é", "​﻿", "ℌ𝔢llo", "it's We'LL", "１２３ ½", "العربية 中文 ไทย", "\r\n\t  end "]


@pytest.fixture(scope="module")
def encoder():
    return tokenizer.Encoder(tokenizer.model(PATH))


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(PATH, "rb") as f:
        found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=found, special_tokens={})


@pytest.mark.parametrize("text", ODD)
def test_ids_of_odd_texts(encoder, reference, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_and_round_trip(encoder, reference, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = encoder.encode(text)
    assert ids == reference.encode_ordinary(text) and tokenizer.Decoder(PATH).decode(ids) == text


def test_encoded_frame(spark, monkeypatch):
    monkeypatch.setattr(tokenizer, "BATCH_IDS", 5)
    data = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello world, hello", "x"), (3, "hello world, hello", "x"), (None, "a", None)], "doc_id long, text string, ids string")
    made = {(r["doc_id"], tuple(r["ids"])) for r in tokenizer.encoded(data, ["doc_id"]).collect()}
    hello = tuple(tokenizer.Encoder(tokenizer.model(PATH)).encode("hello world, hello"))
    assert {(1, ()), (2, ()), (3, hello)} < made and len(made) == 4
    assert [r["n_tokens"] for r in tokenizer.encoded(data, ["doc_id"], counts=True).orderBy("doc_id").collect()] == [1, 0, 0, len(hello), len(hello)]
    assert tokenizer.encoded(data.limit(0), ["doc_id"]).count() == 0


NAMES = formatting.FIELDS


def content(text):
    folded = unicodedata.normalize("NFC", text)
    out, name = [], None
    for w in re.findall(r"[^\W_]+", folded.lower()):
        if w in NAMES:
            name = w
            out.append([name])
        elif out:
            out[-1].append(w)
    return tuple(sorted(map(tuple, out)))


def variant(rng, fields):
    parts = list(fields)
    rng.shuffle(parts)
    made = []
    for name, value in parts:
        v = "".join(rng.choice([c.upper(), c.lower()]) for c in value).replace(" ", rng.choice([" ", "  ", " ", "-", "\t"]))
        made.append(rng.choice([name, name.upper()]) + rng.choice([":", " = ", "→"]) + rng.choice(["", "“"]) + v + rng.choice(["", "!", " ."]))
    text = rng.choice(["; ", "\n", " | "]).join(made)
    return unicodedata.normalize("NFD", text) if rng.random() < 0.2 else text


@pytest.mark.parametrize("bits,least", [(64, 10**9), (64, 5), (3, 10**9), (0, 5)])
def test_copies(spark, bits, least):
    rng = random.Random(bits)
    kinds = [tuple((n, rng.choice(["ada lee", "ñu øs", "élan 12", "7 b", "ää"])) for n in rng.sample(NAMES, rng.choice([2, 3]))) for _ in range(12)]
    rows = [(f"r{i:03d}", variant(rng, rng.choice(kinds))) for i in range(90)]
    rows += rows[:5] + [("n1", None), (None, rows[0][1]), ("e1", ""), ("e2", " .,"), ("e3", "no field here"), ("big", "name: " + "x" * 50_000), ("big2", "NAME= " + "X" * 50_000 + "!"), ("zero", "name: a\0b"), ("zero2", "NAME: a b")]
    df = formatting.copies(spark.createDataFrame(rows, "record_id string, value string").selectExpr("*", "1 as h1", "2 as kept", "3 as _salt"), bits=bits, min_rows=least)
    groups = defaultdict(set)
    for r, v in rows:
        if r is not None and v is not None and content(v):
            groups[content(v)].add(r)
    want = {(min(g), r) for g in groups.values() for r in g if r != min(g)}
    assert {tuple(r) for r in df.collect()} == want and df.count() == len(want)
    assert {tuple(r) for r in formatting.kept_records(df).collect()} == {(min(g), len(g)) for g in groups.values() if len(g) > 1}


def test_same_content_by_two_pointers():
    same = formatting.same_content
    assert same("name: A-b; ward: 3", "WARD=3 | Name “a B”") and not same("name: ab; ward: 3", "name: a b; ward: 3")
    assert not same("name: a; ward: 3", "name: a") and not same("name: é", "name: e") and same("name: É", "name: é")
    assert not same("name: a b", "name: b a") and not same("name: a", "name: a b") and not same("name: a b", "name: a")
    assert same("name: x name: y", "name: y NAME x") and not same("name: x name: y", "name: y name: y")


def brute_route(sizes, quotas, repeats):
    """The most that can be routed, over all ways in unit steps."""
    best = 0
    keys = [(p, s) for p in sizes for s in p]
    for flow in itertools.product(*(range(min(quotas[s], sizes[p] * repeats[s]) + 1) for p, s in keys)):
        used = Counter()
        for (_, s), f in zip(keys, flow, strict=True):
            used[s] += f
        if all(used[s] <= q for s, q in quotas.items()):
            best = max(best, sum(flow))
    return best


def test_route_fills_the_quotas_as_far_as_possible():
    rng = random.Random(1)
    for _ in range(40):
        sizes = {p: rng.randrange(1, 4) for p in (("a",), ("b",), ("a", "b")) if rng.random() < 0.8}
        quotas, repeats = {s: rng.randrange(7) for s in "ab"}, {s: rng.randrange(1, 3) for s in "ab"}
        flow = mixing.route(sizes, quotas, repeats)
        assert sum(flow.values()) == brute_route(sizes, quotas, repeats)
        assert all(f <= sizes[p] * repeats[s] for (p, s), f in flow.items())
        assert all(sum(f for (_, s), f in flow.items() if s == x) <= q for x, q in quotas.items())


def test_mix(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice([None, *range(0, 40)]), [rng.choice(["a", "a", "a", "b", "c", "other", None])]) for i in range(600)]
    docs += docs[:3] + [(None, 5, ["b"]), (900, 7, []), (901, 7, None), (902, 6, ["a", "b"])]
    targets = [("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("none", 0.1, 3), ("zero", 0.0, 1), (None, 1.0, 1)]
    data = spark.createDataFrame(docs, "doc_id long, n_tokens long, sources array<string>")
    goal = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    uses, report = mixing.mix(data, goal)
    shares = {r["source"]: r for r in report.collect()}
    most = {s: m for s, _, m in targets}
    largest = max(n or 0 for _, n, _ in docs)
    for s, r in shares.items():
        reachable = min(r["quota"], r["tokens_available"] * most[s])
        assert reachable - 2 * largest <= r["tokens_used"] <= reachable, s
    for r in uses.collect():
        assert 1 <= r["uses"] <= most[r["source"]] and r["source"] in most
    assert shares["none"]["tokens_used"] == 0 and abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9
    again, _ = mixing.mix(data.repartition(7), goal)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, uses.collect()))
    other, _ = mixing.mix(data, goal, seed=5)
    assert Counter(map(tuple, other.collect())) != Counter(map(tuple, uses.collect()))
    _, r = mixing.mix(data, goal, total=100)
    assert {x["source"]: x["tokens_used"] for x in r.collect()}["a"] <= 40
    for docs_, goal_ in ((data.limit(0), goal), (data, goal.limit(0))):
        uses, report = mixing.mix(docs_, goal_)
        assert uses.count() == 0 and report.where("tokens_used > 0").count() == 0


def test_many_membership_patterns(spark, monkeypatch):
    """Beyond the patterns that are routed as they are no document is left out, and no cap is broken."""
    rng = random.Random(8)
    names = ["a", "b", "c", "d"]
    docs = [(i, rng.randrange(1, 20), rng.sample(names, rng.randrange(1, 5))) for i in range(400)]
    data = spark.createDataFrame(docs, "doc_id long, n_tokens long, sources array<string>")
    goal = spark.createDataFrame([(s, 0.25, 2) for s in names], "source string, target_share double, max_repeats int")
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 3)
    routed = []
    route = mixing.route
    monkeypatch.setattr(mixing, "route", lambda sizes, quotas, repeats: (routed.append(sizes), route(sizes, quotas, repeats))[1])
    uses, report = mixing.mix(data, goal, total=2 * sum(n for _, n, _ in docs))
    assert sum(routed[0].values()) == sum(n for _, n, _ in docs) and len(routed[0]) <= 7
    own = {i: set(s) for i, _, s in docs}
    rows = uses.collect()
    assert all(r["source"] in own[r["doc_id"]] and 1 <= r["uses"] <= 2 for r in rows) and {r["doc_id"] for r in rows} == set(own)
    offered = {r["source"]: r["tokens_available"] for r in report.collect()}
    assert offered == {s: sum(n for _, n, own_ in docs if s in own_) for s in names}


TALK = ["The lid keeps its shape and I use it almost every day in the small kitchen.", "Delivery took nine days, which was fine, although nobody answered my letters.", "My brother laughed when the strap came loose within a week of careful use.", "It weighs about two kilos, so carrying it up the stairs is no trouble at all."]


def spammy():
    rng = random.Random(3)
    keyword = ", ".join(rng.choice(["kettle", "kettles", "cheap kettle", "kettle deal", "buy kettle"]) for _ in range(60))
    links = "\n".join(f"{i}. kettle deal http://x{i}.test/kettle" for i in range(20))
    tags = " ".join(f"#kettle_{i}_deal" for i in range(20))
    return [keyword, links, tags, TALK[0] + " " + keyword, "<p>" + links.upper() + "</p>", tags.replace("#", "tag:"), keyword.replace(", ", " ")]


def test_stuffed_pages(spark):
    honest = [*TALK, " ".join(TALK), TALK[0] + " #kettle www.shop.test", "", " ", None, "👍", base64.b64encode(random.Random(9).randbytes(400)).decode(), "H̉ẽl̀ló t̂h̃èr̉e ̂m̃y f̀r̉íend, the lid is fine", "Good. Good. Good.", " ".join(TALK * 40)]
    rows = [(i, t, f"h{i % 4}") for i, t in enumerate(honest)] + [(100 + i, t, None if i == 2 else f"h{i % 5}") for i, t in enumerate(spammy())]
    rows += [(200, spammy()[0], "h1"), (200, spammy()[0], "h1"), (None, spammy()[0], "h1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, who string").selectExpr("*", "1 as kinds", "2 as phrase", "3 as _key")
    for least, small in ((10**9, 10**6), (10**9, 0), (20, 0)):
        assert {r[0] for r in spam.stuffed(df, "who", min_rows=least, small=small).collect()} == {200, *range(100, 107)}
    assert spam.stuffed(df.limit(0), "who").count() == 0


def test_form_alone_makes_no_case(spark):
    """A list whose phrases no other host's lists hold is none; with three hosts it is, whatever the order of its words."""
    one = " ".join(random.Random(5).choices(["sofa", "cheap", "buy", "deal"], k=80))
    rows = [(i, t, f"h{i}") for i, t in enumerate(TALK)] + [(10 + i, one, "h9") for i in range(5)]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string, who string")
    assert spam.stuffed(frame(rows), "who").count() == 0
    mixed = [" ".join(random.Random(9 + i).choices(["sofa", "cheap", "buy", "deal"], k=80)) for i in range(2)]
    assert {r[0] for r in spam.stuffed(frame([*rows, (20, mixed[0], "h8"), (21, mixed[1], "h7")]), "who").collect()} == {*range(10, 15), 20, 21}


def test_a_sentence_said_again_and_again_is_no_list(spark):
    """Its words repeat like keywords, but its phrases are known from sentences of other hosts."""
    again = "The foam is far too thin for the price. " * 2 + "The hinge is far too thin for the price. " * 2 + "The lid is far too thin for the price."
    assert page(again).listed.mean() > 0.5
    parts = ["foam", "hinge", "lid", "cable", "strap", "zip"]
    others = [f"{t} Also, the {w} is far too thin for the price of one. {t}" for t, w in zip(TALK * 3, parts * 2, strict=True)]
    others += [f"{t} But the {w} is far too thin for the price. {u}" for w in parts[:3] for t, u in itertools.pairwise(TALK)]
    words = ["kettle", "cheap", "buy", "deal"]
    lists = [(200 + i, " ".join(random.Random(i).choices(words, k=60)), f"h{i}") for i in range(3)]
    # the sentence stands in lists of three hosts as well
    rows = [*((1 + i, again, f"h{i}") for i in range(3)), *((10 + i, t, f"h{i}") for i, t in enumerate(others)), *lists]
    df = spark.createDataFrame(rows, "doc_id long, text string, who string")
    for small in (10**6, 0):
        assert {r[0] for r in spam.stuffed(df, "who", small=small).collect()} == {200, 201, 202}


def test_tokens():
    text = 'See [a kettle](https://x.test/a) or <a href="http://y.test">two words</a> <br> www.z.test/1 kettle.shop.example #tag_One tag:Two it&#39;s 3.50 end.Then z.B. Kettles'
    p = page(text)
    assert p.kind.tolist().count(LINK) == 4 and p.kind.tolist().count(TAG) == 2 and tokens(text)[-1] == "kettles" and "then" in tokens(text)
    assert page("kettle Kettles").word.tolist() == [0, 0] and len(page("").kind) == 0 and len(page(" .,;").kind) == 0
    assert page("desk lamp KC-3613 / tent, x").begins.tolist() == [True, False, False, True, True]


def brute_phrases(text):
    """Sets of words of all phrases, with how many words each has, straight from the definition."""
    p, out = page(text), []
    starts = [*(i for i, b in enumerate(p.begins) if b), len(p.begins)]
    for a, b in itertools.pairwise(starts):
        out += [(i, min(5, b - a)) for i in range(a, max(b - 4, a + 1))]
    out += [(i, 2) for i in range(len(p.listed) - 1) if p.listed[i] and p.listed[i + 1]]
    return sorted((i, frozenset(p.code[i : i + n].tolist())) for i, n in out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "cc", "#t", "http://x.test", "AB-123", "77", ".", ",", "|", "\n"]), max_size=40))
def test_phrases_are_sets_of_words(parts):
    p = page(" ".join(parts))
    if not len(p.kind):
        return
    at, h, _ = spam.phrases(p)
    want = brute_phrases(" ".join(parts))
    assert sorted(at.tolist()) == [i for i, _ in want]
    _, size, _ = spam.windows(p.begins, p.listed, p.doc)
    got = {}
    for i, n, x in zip(at, size, h.tolist(), strict=True):
        words = frozenset(p.code[i : i + n].tolist())
        special = all(k in (LINK, TAG) for k in p.kind[i : i + n])
        assert (x == 0) == special
        if not special:
            assert got.setdefault(words, x) == x
    assert len(set(got.values())) == len(got)


@pytest.mark.parametrize("piece", ["<a x>", "<a ", "[", "[a](", "[a](b", "<a>b<", "#_", "www", "a.", " ", "-", "<", "&lt;", "x ", ";"])
def test_time_is_linear(piece):
    """A megabyte of unclosed marks takes no longer than one of words."""
    began = time.perf_counter()
    page(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 15


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_with_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    assert difference(queries.QUERIES[name](spark, folder), connect(folder), queries.SQL[name]) == ""


def test_ids_of_all_documents(spark, reference):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    made = {r["doc_id"]: r["ids"] for r in queries.p8_ids(spark, folder).collect()}
    assert made == {d: reference.encode_ordinary(t or "") for d, t in texts.items()}


def test_shares_of_the_documents(spark):
    _, report = queries._mix(spark, "/root/testdata/sf0.01")
    for r in report.collect():
        reachable = min(r["quota"], r["tokens_available"] * r["max_repeats"])
        assert 0.95 * reachable - 500 <= r["tokens_used"] <= reachable


PRODUCTS = {"en": "desk lamp/drill/office chair/kettle/tent/rain jacket/mattress/blender", "de": "Luftpumpe/Mixer/Zelt/Bürostuhl/Kaffeemühle/Bohrmaschine", "fr": "lampe de bureau/veste de pluie/poêle/sac à dos/tente/clavier", "es": "lámpara/taladro/colchón/mochila/batidora/sartén"}
WORDS_FOR = {"en": "offer/original/buy/free shipping/2025/top/cheap", "de": "günstig/Vergleich/Rabatt/kaufen/versandkostenfrei", "fr": "en ligne/pas cher/livraison gratuite/soldes/avis", "es": "envío gratis/rebajas/oferta/comprar/precio"}


def catalogue(lang, n, between, seed=0, code="{}{}-{}"):
    rng = random.Random(seed)
    letter = lambda: rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    one = lambda: f"{rng.choice(PRODUCTS[lang].split('/'))} {rng.choice(WORDS_FOR[lang].split('/'))} {code.format(letter(), letter(), rng.randrange(10, 10000))}".strip()
    return between.join(one() for _ in range(n))


def share(text):
    return page(text).listed.mean()


@pytest.mark.parametrize("lang", sorted(PRODUCTS))
@pytest.mark.parametrize("between", ["\n", " | ", " / ", " • ", " >> ", "\n- ", ", ", " "])
def test_catalogues_are_lists(lang, between):
    for seed in range(5):
        text = catalogue(lang, 40, between, seed)
        for x in (text, text.upper(), f"<p>{text}</p>", text.replace(" ", "  "), text.replace("-", "‑")):
            assert share(x) > 0.9, x
        assert share(catalogue(lang, 5, between, seed)) > 0.9
        assert share(f"{TALK[0]}\n{text} {TALK[1]}") > 0.7
        if between != " ":
            assert share(catalogue(lang, 40, between, seed, "")) > 0.9
        # few items beside many sentences stay few
        assert share(" ".join(TALK) + "\n" + catalogue(lang, 6, between, seed)) < 0.5


def test_codes_and_short_lines_of_honest_reviews_are_no_lists(spark):
    honest = [
        "Last year I compared the old KC-3613 we had with the newer OO-3831 of a friend, and so far the QV-9696 is quieter.",
        "I compared the KC-3613 with the OO-3831, and the QV-9696 is quieter than the DW-1607 but it was not as sturdy as our old MS-1201.",
        "Pros:\n- good handle\n- quiet motor\n- easy cleaning\n- long cable\n- fair price\nCons:\n- heavy lid\n- thin strap\n- loud click\n- slow delivery",
        "Good value, fast delivery, nice colour, solid hinge, sturdy frame. " + TALK[0],
        "Ich habe die Luftpumpe KC-3613 gekauft, und der Mixer OO-3831 war auch dabei. Die Bohrmaschine QV-9696 ist nach drei Tagen kaputt, das Zelt DW-1607 hat ein Loch.",
        "We\nhave\nhad\nthe\nkettle\nsince\nmay\nand\nthe\nlid\nkeeps\nits\nshape\nalthough\nthe\nkettle\nis\nheavy",
    ]
    assert sum(share(x) > 0.5 for x in honest) == 2  # those with many codes look like lists by form; nobody else's list holds their phrases
    lists = [(50 + i, catalogue("en", 30, " ", i), f"h{i}") for i in range(5)]
    rows = [*((i, t, f"h{i}") for i, t in enumerate([*honest, *TALK])), *lists]
    assert {r[0] for r in spam.stuffed(spark.createDataFrame(rows, "doc_id long, text string, who string"), "who").collect()} == set(range(50, 55))


def test_catalogues_are_found_whole(spark):
    """Each item is another product with another code; what recurs on other hosts are the items without their codes."""
    rows = [(i, t, f"h{i}") for i, t in enumerate([*TALK, "Even my team likes the KC-3613 more than the OO-3831."])]
    cases = [catalogue(lang, 30, between, seed) for lang in sorted(PRODUCTS) for seed, between in enumerate(("\n", " | ", " / ", ", "))]
    mixed = [TALK[2] + "\n" + cases[0], cases[1] + " " + TALK[3]]
    half = [" ".join(TALK * 2) + " " + catalogue("en", 8, " | ", 3)]
    rows += [(100 + i, t, f"h{i % 7}") for i, t in enumerate([*cases, *mixed])] + [(300, half[0], "h2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, who string")
    assert {r[0] for r in spam.stuffed(df, "who").collect()} == set(range(100, 118))
