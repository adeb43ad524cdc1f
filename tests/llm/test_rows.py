"""op3, op4, op5, op9: operators that judge each row."""

import zlib

import brute
import pytest

from memlens.llm import language, pii, quality, toxicity
from memlens.llm.catalog import op3_toxicity, op9_language

SF = "/root/testdata/sf0.01"


def spans_of(spark, text):
    df = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    return [(s.kind, s.start, s.end) for s in df.first().spans]


@pytest.mark.parametrize("text", [
    "a@b.c@d.ef x@y.com+z@w.org .@-.- a@b", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0003.255 1.2.3.256", "4111 1111 1111 1111 5 4111-1111-1111-1111, 4111  1111 1111 1111",
    "+1 (555) 123-4567. +12 +1 2345678901234567 +1--2", "é😀 mail: q@w.de 漢 +49 30 1234567", "", "1" * 400 + " " + "4111111111111111"])
def test_base_spans_match_the_stated_patterns(spark, text):
    want = [(k, s, e) for s, _, e, k in brute.base_spans(text)]
    assert [s for s in spans_of(spark, text) if s[0] in pii.BASE_KINDS] == want


def test_added_kinds_need_their_checksum_or_context(spark):
    assert ("iban", 6, 28) in spans_of(spark, "konto DE89370400440532013000")
    assert not [s for s in spans_of(spark, "konto DE88370400440532013000") if s[0] == "iban"]
    assert [s[0] for s in spans_of(spark, "social security 123-45-6789")] == ["ssn"]
    assert spans_of(spark, "part number 123-45-6789") == []


@pytest.mark.parametrize("text, places", [
    ("IBAN DE89370400440532013000 Bank", [(5, 27)]), ("DE89 3704 0044 0532 0130 00 AND GO", [(0, 27)]), ("GB82 WEST 1234 5698 7654 32 12 euro", [(0, 27)]),
    ("NO9386011117947 NO93 8601 1117 947 12", [(0, 15), (16, 34)]), ("DE89370400440532013000 GB82WEST12345698765432 X", [(0, 22), (23, 45)]),
    ("AB12 3456 7890 1234 DE89 3704 0044 0532 0130 00 Bank", [(20, 47)]), ("é😀 MT84MALT011000012345MTLCAST001S B2", [(3, 34)]),
    ("DE89370400440532013000a", []), ("aDE89370400440532013000", []), ("DE88 3704 0044 0532 0130 00 AND GO", []), ("IBAN DE89370400440532013000 Bank " * 600, [(33 * i + 5, 33 * i + 27) for i in range(600)])])
def test_account_numbers_before_other_words(spark, text, places):
    assert [s[1:] for s in spans_of(spark, text) if s[0] == "iban"] == places


def test_redaction(spark):
    df = pii.find_pii(spark.createDataFrame([(1, "to a@b.co, 1.2.3.4 é")], "doc_id long, text string"))
    from pyspark.sql import functions as F
    assert df.select(pii.redact(F.lit("to a@b.co, 1.2.3.4 é"), F.col("spans")).alias("r")).first().r == "to <EMAIL>, <IP> é"


def test_pii_of_given_documents(documents):
    want = {r.doc_id: brute.pii_digest(r.text) for r in documents.collect()}
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.digest(pii.find_pii(documents)).collect()}
    assert got == want


def test_pii_odd_rows(odd, empty):
    got = pii.digest(pii.find_pii(odd)).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert len(got) == odd.count() and all((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute.pii_digest(texts[r.doc_id]) for r in got if r.doc_id)
    assert pii.digest(pii.find_pii(empty)).count() == 0


def test_quality_counts(documents, odd):
    for df in (documents, odd.where("doc_id is not null")):
        want = {r.doc_id: brute.quality(r.text) for r in df.collect()}
        got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(df).collect()}
        assert got == want



def test_quality_verdicts_against_brute_force(documents, odd, spark):
    """The verdict from the text alone: words, ratios of the whole and of 1,024-byte chunks, bands stated in the module."""
    import zstandard
    packed = lambda raw: len(zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False).compress(raw)) / len(raw)

    def judge(text):
        raw = (text or "").encode()
        n_words, *_, repeats, _ = brute.quality(text)
        if n_words < 50:
            return "short"
        if 2 * repeats > n_words:
            return "repeated words"
        low, high = next((a, b) for edge, a, b in reversed(quality.DOC_BANDS) if edge <= len(raw))
        if not low <= packed(raw) <= high:
            return "repetitive" if packed(raw) < low else "incompressible"
        cuts = list(range(0, len(raw), 1024))
        if len(cuts) > 1 and len(raw) - cuts[-1] < 512:
            cuts.pop()
        marks = "".join(".x"[not 0.49 <= packed(raw[a:b]) <= 0.72] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)) if len(cuts) > 1 else ""
        return "odd chunks" if marks.count("x") >= 2 and ("xxx" in marks or 4 * marks.count("x") >= len(marks)) else "kept"

    for df in (documents, odd.where("doc_id is not null")):
        texts = {r.doc_id: r.text for r in df.collect()}
        got = quality.quality_rules(df).collect()
        assert all(r.verdict == judge(texts[r.doc_id]) and r.kept == (r.verdict == "kept") for r in got)


def test_quality_verdicts(spark, empty, documents):
    import random
    rng = random.Random(1)
    junk = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ+/", k=76)) for _ in range(n))
    clean = max((r.text for r in documents.collect() if r.lang == "en" and r.text), key=lambda t: 12_000 - abs(len(t) - 12_000))
    third = clean[: len(clean) // 3] + junk(len(clean) // 3 // 76) + clean[len(clean) // 3 : 2 * len(clean) // 3]
    rows = [(1, junk(300)), (2, clean), (3, "short text"), (4, "again and " * 200), (5, None), (6, third), (7, " ".join(w + rng.choice(["%%%", "$$$", "###", "&&&", "***"]) for w in clean.split()))]
    got = {r.doc_id: r.verdict for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "incompressible" and got[2] == "kept" and got[3] == got[5] == "short" and got[4] == "repeated words"
    assert got[6] in ("odd chunks", "incompressible") and got[7] == "repetitive"
    assert quality.quality_rules(empty).count() == 0


def test_bands_decide_on_held_out_labels(spark):
    """Bands catch most of the poor texts that the word rules pass, and hardly any clean one, on the fifth they were not fitted on."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("crc32(encode(string(doc_id), 'UTF-8')) % 5 = 0")
    kept = {(r.quality, r.kept): r["count"] for r in quality.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()}
    assert kept[0, False] > 0.7 * (kept[0, False] + kept[0, True]) and kept.get((1, False), 0) <= 0.01 * kept[1, True]


def test_bands_are_fitted_to_clean_texts(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bands = quality.fit_bands(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert [b[0] for b in bands] == list(quality.LENGTH_EDGES) and all(0 <= low < high for _, low, high in bands)
    wanted = dict((b[0], b[1:]) for b in quality.DOC_BANDS)
    assert all(abs(low - wanted[edge][0]) < 0.03 for edge, low, _ in bands if 600 <= edge <= 4000)


def test_quality_keeps_clean_prose(documents, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1")
    judged = quality.quality_rules(documents).join(labels, "doc_id").where("n_words >= 50 AND NOT base_failed")
    assert judged.count() > 20 and judged.where("NOT kept").count() == 0


def test_toxicity_on_held_out_rows(spark):
    got = {r.doc_id: r for r in op3_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in got.items())
    held = [(labels[d], got[d].predicted) for d in labels if d in got and got[d].held_out]
    assert sum(y == p for y, p in held) >= 0.93 * len(held)
    assert sum(p for y, p in held if not y) <= 0.05 * len(held)


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (2, 1), (4, 0), (6, 1), (8, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    assert toxicity.toxicity(odd, labels).where("score is null").count() == 0
    assert toxicity.toxicity(odd, labels).count() == odd.count()
    assert toxicity.toxicity(odd, labels.where("false")).where("predicted = 1").count() == 0
    assert toxicity.toxicity(empty, labels).count() == 0


def test_label_model_discounts_voters_that_repeat_each_other():
    import numpy as np
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    good = np.where(rng.random(4000) < 0.9, y, ~y)
    copies = np.where(rng.random(4000) < 0.7, y, ~y)
    votes = np.stack([good, copies, copies, copies, np.where(rng.random(4000) < 0.97, y, ~y)], 1).astype(float)
    model = toxicity.LabelModel.fit(votes, votes[:, -1])
    assert (model.discount[1:4] < 0.4).all() and model.discount[0] > 2 * model.discount[1:4].max()
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.96


def test_language_on_held_out_rows(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op9_language(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [docs[r.doc_id].lang == r.lang_pred for r in got if r.held_out and docs[r.doc_id].lang]
    assert sum(held) >= 0.97 * len(held)


def test_rare_languages_of_one_script_in_a_latin_corpus(spark):
    import random
    rng = random.Random(9)
    latin = ["".join(rng.choices("etaoinshrdlucmfwypvbgkjqxzéèüöäßñçàêôï", k=rng.randrange(2, 9))) for _ in range(400)]
    # two languages over the same letters, told apart by which ones are common
    letters = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    words = {"aa": ["".join(rng.choices(letters[:16], k=rng.randrange(2, 5)) + rng.choices(letters[16:], k=2)) for _ in range(300)],
             "bb": ["".join(rng.choices(letters[16:], k=2) + rng.choices(letters[:16], k=rng.randrange(2, 5))) for _ in range(300)]}
    text = lambda pool, n: " ".join(rng.choices(pool, k=n))
    train = [("la", text(latin, 2000)) for _ in range(100)] + [(name, text(pool, 100)) for name, pool in words.items() for _ in range(10)]
    model = language.train(spark.createDataFrame(train, "lang string, text string"))
    held = [(name, text(pool, 4)) for name, pool in words.items() for _ in range(100)]
    got = language.identify(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(held)], "doc_id long, text string"), model).collect()
    assert sum(held[r.doc_id][0] == r.lang_pred for r in got) >= 0.99 * len(held)
    seen = {b for keys, _ in model.counts.values() for b in (keys % 256).tolist()}
    assert seen == {b for _, t in train for b in t.encode()}


def test_language_odd_rows(odd, empty):
    got = {r.doc_id: r for r in language.predict_languages(odd).collect()}
    assert len(language.predict_languages(odd).collect()) == odd.count()
    assert {got[d].lang_pred for d in (1, 2, 3, 9, 11)} == {"und"} and got[9].score == 0.0
    assert got[4].lang_pred in ("en", "de", "fr")
    assert language.predict_languages(empty).count() == 0


def test_code_lengths_are_a_probability():
    import numpy as np
    rng = np.random.default_rng(2)
    size = 5
    keys = np.unique(rng.integers(0, size**4, 60))
    table = language.cost_table(keys, rng.integers(1, 9, len(keys)), size).reshape(-1, size)
    assert (np.exp2(-table).sum(axis=1) <= 1 + 1e-5).all() and np.isfinite(table).all()
    seen = np.zeros(size**4)
    seen[keys] = 1
    assert table.reshape(-1)[keys].mean() < table.reshape(-1)[seen == 0].mean()
