"""op2, op6, op7, op8, op10 and the pipeline: operators on whole tables."""

import hashlib
import io
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import compare, duck  # noqa: E402

from memlens.llm import decontamination, html, mixing, sharding, warc  # noqa: E402
from memlens.llm.catalog import ORACLE_SQL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_same_rows_as_duckdb(spark, key):
    assert compare(spark, duck(SF), SF, QUERIES[key], ORACLE_SQL[key]) == ""


# --- op2


def site(n):
    rng = random.Random(4)
    pages = []
    for i in range(n):
        body = "".join(f"<p>Story {i} part {j} {rng.random()}</p>" for j in range(4))
        pages.append((i, f"http://h.example/a/{i:03d}", f"<html><head><title>t</title></head><body><div>Site name</div><div>Home</div><div>News</div>{body}<div>All rights &copy; reserved</div></body></html>",
                      "\n".join(f"Story {i} part {j}" for j in range(4))))
    return pages


def test_differencing_finds_the_text_of_pages_without_structure(spark):
    pages = site(12)
    got = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")).collect()}
    for i, _, _, want in pages:
        lines = got[i].split("\n")
        assert len(lines) == 4 and all(a.startswith(b) for a, b in zip(lines, want.split("\n"), strict=True))


def test_copies_under_neighbouring_addresses_lose_their_furniture(spark):
    """Ten copies of one page between other pages: each is compared with a page that differs."""
    pages = [p[:3] for p in site(12)]
    copy = pages[5][2]
    pages += [(100 + i, f"http://h.example/a/005-{i}", copy) for i in range(10)]
    got = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {got[100 + i] for i in range(10)} == {got[5]} and len(got[5].split("\n")) == 4 and got[5].startswith("Story 5 part 0")


def test_what_an_article_holds_stays(spark):
    page = """<body><main><ul><li>Home</li></ul><article><h1>T</h1><figure><img src=x><figcaption>A caption</figcaption></figure><div class="share-price related">Prices</div>
        <div class="advert">Buy</div><p>Text</p><section class="comments"><p>First!</p></section></article></main></body>"""
    other = page.replace("Text", "Other text").replace("<h1>T", "<h1>U")
    df = spark.createDataFrame([(1, "http://h/a", page), (2, "http://h/b", other)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract_text(df).collect()} == {1: "T\nA caption\nPrices\nText", 2: "U\nA caption\nPrices\nOther text"}


def test_articles_of_given_pages(spark):
    import html as entities
    import re
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in html.extract_text(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        inside = re.search("<article>(.*?)(</article>|$)", rows[r.page_id], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:h1|p|br)>", inside)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_longest_common_subsequence():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(9))] for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        places = html.shared_lines(np.array(a), np.array(b))
        assert len(places) == best[-1, -1] and places == sorted(set(places))
        it = iter(b)
        assert all(a[p] in it for p in places)


def test_html_odd_rows(spark):
    rows = [(1, None, None), (2, "http://a/x", None), (3, "http://a/y", ""), (None, "http://a/z", "<p>x"), (4, "not a url", "<p>a &amp; b<script>x</script><!-- c --> c</p"),
            (5, "http://a/y", "<div>" * 3000 + "deep"), (5, "http://a/y", "<p>again")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS page", "'x' AS hashes", "'x' AS text")
    got = html.extract_text(df).collect()
    assert len(got) == 7 and all(r.text is not None for r in got)
    assert {r.text for r in got if r.page_id in (1, 2, 3)} == {""} and [r.text for r in got if r.page_id == 4] == ["a & b c"]
    assert html.extract_text(df.where("false")).count() == 0


# --- op6


def test_alignment_is_the_best_local_one():
    rng = random.Random(3)
    for _ in range(150):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        score, first, end = decontamination.align(np.array(a), np.array(b))
        assert score == h.max() and 0 <= first <= end <= len(a) and end - first >= score


def test_copies_and_edited_copies_of_items(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    items = [[word() for _ in range(40)] for _ in range(5)]
    filler = lambda n: [word() for _ in range(n)]
    edited = [w if i % 7 else word() for i, w in enumerate(items[1])]
    docs = [(10, filler(50) + items[0] + filler(30)), (11, filler(9) + edited + filler(9)), (12, items[2][:20] + filler(3) + items[2][20:]), (13, filler(300)),
            (14, filler(40) + items[3][:8] + filler(40)), (15, [w.upper() + "," for w in items[4]])] + [(100 + i, filler(4) + items[0][:12] + filler(4)) for i in range(60)]
    found = decontamination.find_contamination(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"),
                                               spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(10, 0), (11, 1), (12, 2), (15, 4)]
    row = found.where("doc_id = 10").first()
    assert (row.score, row.item_words, row.first_word, row.end_word) == (40, 40, 50, 90)


def all_alignments(docs, items):
    """{(doc, item): score} of all pairs that score as a copy, by Smith-Waterman on whole texts."""
    import re
    words = lambda t: [w.lower() for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", t or "")]
    number: dict[str, int] = {}
    coded = lambda t: np.array([number.setdefault(w, len(number)) for w in words(t)], np.int64)
    items = {i: coded(t) for i, t in items.items()}
    out = {}
    for d, t in docs.items():
        a = coded(t)
        for i, b in items.items():
            needed = decontamination.needed_score(len(b))
            if len(b) >= decontamination.MIN_ITEM_WORDS and np.isin(b, a).sum() >= needed:
                score = decontamination.best_alignment(a, b)[0]
                if score >= needed:
                    out[d, i] = score
    return out


def test_all_copies_of_given_items_are_found(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = all_alignments({r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in items.collect()})
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.find_contamination(docs, items).collect()}
    assert got == want and len(want) >= 3


def test_no_edit_at_the_threshold_hides_a_copy(spark):
    """Every fourth word replaced, a word put in after every two, every third word left out of a longer excerpt; common words only."""
    rng = random.Random(38)
    common = ["".join(rng.choices("abcdefghij", k=3)) for _ in range(60)]
    word = lambda: "".join(rng.choices("klmnopq", k=6))
    items = [[rng.choice(common) if i % 3 else word() for i in range(rng.choice([9, 16, 40, 41, 70]))] for _ in range(12)] + [[rng.choice(common) for _ in range(40)]]
    docs = {}
    for i, item in enumerate(items):
        docs[10 * i] = [w if k % 4 else word() for k, w in enumerate(item, 1)]
        docs[10 * i + 1] = [x for k, w in enumerate(item, 1) for x in ([w, word()] if k % 2 == 0 else [w])]
        docs[10 * i + 2] = [w for k, w in enumerate(item) if k % 7]
        docs[10 * i + 3] = [rng.choice(common) for _ in range(300)]
    texts = {d: " ".join([rng.choice(common) for _ in range(20)] + w + [rng.choice(common) for _ in range(20)]) for d, w in docs.items()}
    tests = {i: " ".join(w) for i, w in enumerate(items)}
    found = decontamination.find_contamination(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(tests.items()), "item_id long, text string"))
    got, want = {(r.doc_id, r.item_id): r.score for r in found.collect()}, all_alignments(texts, tests)
    assert got == want and sum(d % 10 == 0 for d, _ in want) >= 9 and sum(d % 10 == 1 for d, _ in want) >= 5


def test_copies_of_an_edited_item_do_not_hide_it(spark):
    rng = random.Random(18)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    items = [[word() for _ in range(40)] for _ in range(2)]
    edited = [[w if i % 6 else word() for i, w in enumerate(item)] for item in items]
    docs = [(1, items[0]), (2, items[1])] + [(100 + i, edited[0]) for i in range(50)] + [(200 + i, [word() for _ in range(9)] + edited[1] + [word() for _ in range(9)]) for i in range(50)]
    found = decontamination.find_contamination(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"),
                                               spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.score, r.first_word) for r in found.collect()}
    assert set(got) == {(1, 0), (2, 1)} | {(100 + i, 0) for i in range(50)} | {(200 + i, 1) for i in range(50)}
    assert {got[100 + i, 0] for i in range(50)} == {(27, 1)} and {got[200 + i, 1] for i in range(50)} == {(27, 10)}


def test_long_excerpts_of_long_items(spark):
    rng = random.Random(28)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    item = [word() for _ in range(300)]
    docs = [(1, item[80:220]), (2, [word() for _ in range(20)] + item[10:40]), (3, item[50:79]), (4, item)]
    found = decontamination.find_contamination(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"),
                                               spark.createDataFrame([(0, " ".join(item))], "item_id long, text string"))
    assert sorted((r.doc_id, r.score, r.first_word) for r in found.collect()) == [(1, 140, 0), (2, 30, 20), (4, 300, 0)]


def test_decontamination_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (None, "one two three four"), (4, "word0x0 word1x1 word2x2 word3x3 word4x4 word5x5"), (4, "word0x0 word1x1 word2x2 word3x3 word4x4 word5x5")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.find_contamination(odd, items).collect()) == [(4, 4), (5, 4)]
    assert decontamination.find_contamination(empty, items).count() == 0 and decontamination.find_contamination(odd, items.where("false")).count() == 0


# --- op7


def test_ranges_of_any_size_give_each_record_once():
    rng = random.Random(2)
    bodies = [rng.randbytes(rng.randrange(0, 400)) + warc.MAGIC * rng.randrange(3) + (warc._gzip(b"WARC/1.1 inside") if i % 5 == 0 else b"") for i in range(40)]
    members = [warc._gzip(warc.record(i, f"u{i}", b, hashlib.sha256(b).hexdigest(), None)) for i, b in enumerate(bodies)]
    data = b"".join(members)
    for step in (7, 101, 1000, len(data) + 1):
        got = [warc.parse(raw) for at in range(0, len(data), step) for raw in warc.members(io.BytesIO(data), len(data), at, min(at + step, len(data)))]
        assert [block for _, block in got] == bodies


def test_warc_round_trip_of_odd_rows(spark):
    text = "<p>é " * 40
    rows = [(1, None, None), (2, "u\r\nX: y %", ""), (3, "u", text), (4, None, text), (5, "v", text), (6, "w", "short"), (7, "w", "short"), (None, "z", text)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS id", "'x' AS digest", "'x' AS first")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df, range_bytes=64).collect()}
    data = text.encode()
    assert got[3] == (len(data), hashlib.sha256(data).hexdigest(), "response", None) and got[4][2:] == ("revisit", 3) and got[5][2:] == ("revisit", 3)
    assert got[1] == got[2] == (0, hashlib.sha256(b"").hexdigest(), "response", None) and got[6][2] == got[7][2] == "response" and got[None][2] == "response"
    assert warc.round_trip(df.where("false")).count() == 0
    records = warc.parse(warc.record(2, "u\r\nX: y %", b"", "", None))[0]
    assert warc._plain(records["WARC-Target-URI"]) == "u\r\nX: y %" and "X" not in records


# --- op8


def test_budgets_go_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 100), ("a", "en", "s2", 1000), ("a", "de", "s3", 1000), ("b", "en", "s4", 1000)], "domain string, lang string, source string, tokens long")
    weights = leaves.selectExpr("domain", "lang", "source", "CASE source WHEN 's1' THEN 2.0 WHEN 's4' THEN 4.0 ELSE 1.0 END AS weight")
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, weights, 800.0, False, 1).collect()}
    assert got == {"s1": 100, "s2": 200, "s3": 100, "s4": 400}  # s2 takes what s1 lacks; de and domain b keep their shares
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, weights, 3000.0, False, 1).collect()}
    assert got == {"s1": 100, "s2": 1000, "s3": 900, "s4": 1000} or sum(got.values()) == 3000 and got["s1"] == 100
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, weights.where("source <> 's4'"), 9000.0, False, 2).collect()}
    assert got == {"s1": 200, "s2": 2000, "s3": 2000, "s4": 0}


def test_mixing_odd_rows_and_epochs(spark, odd, empty):
    from pyspark.sql import functions as F
    domain = mixing.source_domain(F.col("source"))
    rows = mixing.mix(odd, mixing.tree_of(odd), domain, 10.0, share=True, max_epochs=3)
    counts = Counter(r.doc_id for r in rows.collect())
    assert counts[4] == 3 and counts[6] == 6 and counts[None] == 6 and counts[1] == 3
    assert mixing.mix(empty, mixing.tree_of(empty), domain, 0.5, share=True).count() == 0
    half = mixing.mix(odd, mixing.tree_of(odd), domain, 0.0, share=True)
    assert half.count() == 0


# --- op10


def descended(key, tree, seed=0):
    """The shard of one key, by drawing at every node."""
    import math

    import xxhash

    def draw(level, name, weight):
        h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(f"{seed}/{level}/{name}".encode(), h)
        return -math.log(((h >> 11) + 0.5) / 2**53) / weight

    total = lambda t: sum(map(total, t.values())) if isinstance(t, dict) else t
    for level in sharding.LEVELS:
        name = min((n for n in tree if total(tree[n]) > 0), key=lambda n: draw(level, n, total(tree[n])))
        tree = tree[name]
    return name


def test_shards_are_those_of_a_descent_key_by_key(spark, documents):
    tree = {0: {0: {0: 1.0, 1: 3.0}, 1: {4: 0.5}}, 1: {2: {2: 4.0, 3: 0.0}}, 2: {3: {5: 1.0}, 4: {6: 1.0, 7: 2.0, 8: 0.25}}}
    for plan in (tree, sharding.uniform_tree(16), sharding.grow(sharding.uniform_tree(16), 16)):
        got = sharding.assign(documents.select("doc_id"), "doc_id", plan).collect()
        assert {r.doc_id: r.shard for r in got} == {r.doc_id: descended(r.doc_id, plan) for r in got}


def test_growth_moves_rows_only_into_the_new_shard(spark):
    from pyspark.sql import functions as F
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    for n in (1, 4, 16, 17):
        tree = sharding.uniform_tree(n)
        both = sharding.assign(sharding.assign(ids, "doc_id", tree, "a"), "doc_id", sharding.grow(tree, n), "b")
        moved = both.where("a <> b")
        assert moved.where(F.col("b") != n).count() == 0 and abs(moved.count() - 20_000 / (n + 1)) < 700
    heavy = {0: {0: {0: 1.0, 1: 3.0}}, 1: {1: {2: 4.0, 3: 0.0}}}
    share = {r.shard: r["count"] for r in sharding.assign(ids, "doc_id", heavy).groupBy("shard").count().collect()}
    assert set(share) == {0, 1, 2} and abs(share[1] - 7500) < 400 and abs(share[2] - 10_000) < 400


def test_a_weight_moves_rows_only_into_its_own_subtrees(spark):
    """Region 0 > rack 0 > shard 1 grows: other regions, racks and shards only lose rows, and keep the rest in place."""
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = {0: {0: {0: 1.0, 1: 1.0}, 1: {2: 1.0, 3: 1.0}}, 1: {2: {4: 1.0, 5: 1.0}}}
    region, rack = {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1}, {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2}
    grown = {0: {0: {0: 1.0, 1: 2.5}, 1: {2: 1.0, 3: 1.0}}, 1: {2: {4: 1.0, 5: 1.0}}}
    rows = sharding.assign(sharding.assign(ids, "doc_id", tree, "a"), "doc_id", grown, "b").where("a <> b").collect()
    assert len(rows) > 1000
    for r in rows:
        assert region[r.b] == 0
        if region[r.a] == 0:
            assert rack[r.b] == 0
            assert rack[r.a] != 0 or r.b == 1


def test_the_tree_matters_and_wide_trees_run(spark):
    ids = spark.range(3_000).withColumnRenamed("id", "doc_id")
    one_rack, regions = {0: {0: {s: 1.0 for s in range(16)}}}, {s: {s: {s: 1.0}} for s in range(16)}
    placed = sharding.assign(sharding.assign(sharding.assign(ids, "doc_id", sharding.uniform_tree(16), "a"), "doc_id", one_rack, "b"), "doc_id", regions, "c")
    assert placed.where("a <> b").count() > 2000 and placed.where("b <> c").count() > 2000


def test_slots_do_not_depend_on_partitions(spark):
    rows = [(None if i % 3 else 5, f"t{i % 40}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted(map(tuple, sharding.shard_documents(d).collect()), key=repr) for d in (df, df.repartition(7, "text").orderBy("text")))
    assert a == b and len(a) == 300


def test_sharding_rows(documents, odd, empty):
    for df in (documents, odd):
        texts = {r.doc_id: (r.text or "").encode() for r in df.collect()}
        got = sharding.shard_documents(df, 16).collect()
        assert len(got) == df.count() and sharding.shard_documents(df, 16, carry=("text",)).select("doc_id", "text").exceptAll(df.select("doc_id", "text")).count() == 0
        slots = {}
        for r in got:
            slots.setdefault(r.shard, []).append(r.slot)
            if r.doc_id is not None:
                assert r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id])
            assert r.grown_shard in (r.shard, 16)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty).count() == 0


# --- pipeline


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline
    return dict(corpus_pipeline.STAGES)


def plain(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_on_odd_and_empty_tables(spark, odd, empty, stages):
    for name, stage in stages.items():
        for docs in (odd, empty):
            out = stage(spark, docs, SF)
            if name == "sharding":
                added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
                own = [c for c in docs.columns if c not in added]
                assert out.columns == own + added
                assert plain(out.select(own)) == plain(docs.select(own))
            else:
                assert out.columns == docs.columns and plain(out) <= plain(docs)


def test_null_and_repeated_ids_are_judged_row_by_row(spark, stages):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, text(1)), (None, text(1)), (7, text(2)), (7, text(2)), (7, text(3)), (None, item), (7, f"before {item} after"), (8, text(4)), (None, text(4) + " end"), (9, "")]
    docs = spark.createDataFrame([(d, t, "en", "src1", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = [(r.doc_id, r.text) for r in stages["near_copies"](spark, docs, SF).collect()]
    assert sorted(map(repr, near)) == sorted(map(repr, [(None, text(1)), (7, text(2)), (7, text(3)), (7, f"before {item} after") if brute_similar(item) else (7, f"before {item} after"), (8, text(4)), (9, "")]))
    clean = [(r.doc_id, r.text) for r in stages["decontamination"](spark, docs, SF).collect()]
    assert sorted(map(repr, clean)) == sorted(repr(r) for r in rows if item not in r[1])


def brute_similar(item):
    """Whether an item and itself between two words link."""
    import brute
    return len(set(c for _, c in brute.jaccard_components([(0, item), (1, f"before {item} after")]).values())) == 1


def test_mixing_stage_keeps_the_chosen_rows_whatever_their_ids(spark, odd, empty, stages):
    rows = [(d, " ".join(f"w{i}x{j}" for j in range(10)), "en", "src1", i) for i, d in enumerate([None] * 20 + [7] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r) for r in stages["mixing"](spark, docs, SF).collect()]
    assert len(got) == 32 and len(set(got)) == 32 and set(got) <= set(rows)  # one leaf of 400 tokens, 80 % of them


def leaf_shares(tokens, budget):
    """Water filling by hand: {leaf path: tokens} to {leaf path: budget}, equal weights per leaf."""
    def split(leaves, budget, depth):
        if depth == 3:
            return {p: min(budget, float(t)) for p, t in leaves.items()}
        groups: dict = {}
        for p, t in leaves.items():
            groups.setdefault(p[depth], {})[p] = t
        weight, capacity = {g: float(len(v)) for g, v in groups.items()}, {g: float(sum(v.values())) for g, v in groups.items()}
        given, open_, left = {}, set(groups), budget
        while open_:
            per = left / sum(weight[g] for g in open_)
            full = {g for g in open_ if capacity[g] <= per * weight[g] + 1e-9}
            if not full:
                given |= {g: per * weight[g] for g in open_}
                break
            given |= {g: capacity[g] for g in full}
            left -= sum(capacity[g] for g in full)
            open_ -= full
        out = {}
        for g, v in groups.items():
            out |= split(v, given[g], depth + 1)
        return out
    return split(tokens, budget, 0)


def test_pipeline_stages_against_brute_force(spark):
    import brute
    import corpus_pipeline as p
    from memlens.llm import toxicity
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for name, stage in p.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet")) if name == "toxicity" else None
        scores = {r.doc_id: r.score for r in docs.select("doc_id", toxicity.toxic_score(model)(docs["text"]).alias("score")).collect()} if model else {}
        docs = stage(spark, docs, SF).checkpoint()
        rows = docs.collect()
        kept = {r.doc_id for r in rows}
        assert kept <= set(before) and len(kept) == len(rows) and all(r.text == before[r.doc_id].text for r in rows)
        if name == "toxicity":
            assert kept == {d for d, s in scores.items() if s < 0.5}
        elif name == "near_copies":
            assert kept == {d for d, (_, c) in brute.jaccard_components((d, r.text) for d, r in before.items()).items() if d == c}
        elif name == "decontamination":
            assert set(before) - kept == {d for d, _ in all_alignments({d: r.text for d, r in before.items()}, items)}
        elif name == "mixing":
            size = {d: max(1, len(brute.WORD.findall(r.text or ""))) for d, r in before.items()}
            leaf = {d: (f"d{int(r.source[-1]) % 5 if r.source and r.source[-1].isdigit() else 0}", r.lang, r.source) for d, r in before.items()}
            total, chosen = Counter(), Counter()
            for d in before:
                total[leaf[d]] += size[d]
                chosen[leaf[d]] += size[d] * (d in kept)
            for path, budget in leaf_shares(total, 0.8 * sum(total.values())).items():
                out = [size[d] for d in before if leaf[d] == path and d not in kept]
                assert chosen[path] <= budget + 1e-6 and (not out or chosen[path] + max(out) > budget - 1)
        else:
            tree = sharding.uniform_tree(16)
            assert kept == set(before) and all(r.shard == descended(r.doc_id, tree) and r.grown_shard == descended(r.doc_id, sharding.grow(tree, 16)) for r in rows)
        if name != "sharding":
            assert docs.columns == columns
    assert p.run(spark, SF).count() == len(kept)
