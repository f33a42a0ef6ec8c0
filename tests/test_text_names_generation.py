import pytest
from pyspark.sql import functions as F

from wayline.functions import names as N
from wayline.functions import prompts as P
from wayline.functions import text as X
from wayline.operators import genplan
from wayline.sources import corpus, tables


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


def test_names(spark):
    m = one(spark, "Academic_BIOLOGY_01_2020_01_G4B_LV1.txt", N.any_name)
    assert (m.domain, m.field, m.author_id, m.year, m.item_index, m.model, m.level) == ("academic", "BIOLOGY", "01", "2020", "01", "G4B", "LV1")
    assert one(spark, "News_5years_02_2017_103", N.human_name).item_index == "103"
    for bad in ("News_A_01_2020_01_DS_lv1.txt", "News_A_01_20_01.txt", "plain.txt", ""):
        assert one(spark, bad, N.any_name) is None
    assert one(spark, "x/Human/News/5y/old_2013.txt", N.path_meta).asDict() == {"genre": "news", "subfield": "5y", "batch": "01", "year": "2013", "index": "01"}
    assert one(spark, "x/y/old.txt", N.path_meta) is None
    assert one(spark, "m/human/news/bad.txt", N.domain_human_path).error == "file name does not match the grammar"
    assert one(spark, "m/human", N.domain_human_path).error == "unexpected path structure"
    assert one(spark, "a_2020_100.txt", N.year_and_index).item_index == 100
    assert one(spark, "DS_LV3_Academic_BIOLOGY_07", N.split_author).author_id == 7


def test_name_round_trip(spark):
    rows = [("blogs", "lifestyle", "03", "2020", "07", 2, "GEMMA_12B"), ("news", "5years", "12", "2017", "101", None, "OTHER")]
    df = spark.createDataFrame(rows, "g string, s string, b string, y string, i string, l int, p string")
    got = [r["n"] for r in df.select(N.build_name(*[F.col(c) for c in "gsbyilp"]).alias("n")).collect()]
    assert got == ["Blogs_LIFESTYLE_03_2020_07_G12B_LV2.txt", "News_5years_12_2017_101_DS.txt"]


def test_style_features(spark):
    df = spark.createDataFrame([(1, "The cat sat. The dog ran away!"), (2, "  \n"), (3, "...")], "id int, text string")
    r = {x["id"]: x for x in X.style_features(df).collect()}
    assert r[1]["num_words"] == 7 and r[1]["avg_sentence_length"] == 3.5 and r[1]["word_diversity"] == pytest.approx(6 / 7)
    assert r[1]["function_word_ratio"] + r[1]["content_word_ratio"] == 1.0
    assert r[1]["average_word_length"] == pytest.approx(24 / 7)
    assert r[2]["num_words"] == 0 and r[2]["flesch_reading_ease"] == 0.0
    assert r[3]["num_words"] == 0 and r[3]["word_diversity"] == 0.0


def test_syllables_match_the_token_rule(spark):
    words = "beautiful rhythm tsk queue aeiou xyz été naïve a b 123".split()
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["s"] for r in df.select("w", X.syllables(F.lower("w"), F.lit(1)).alias("s")).collect()}
    import re

    assert got == {w: max(1, len(re.findall(f"[{X.VOWEL}]+", w))) for w in words}


def test_decoding(spark):
    df = spark.createDataFrame([(bytearray("é".encode("utf-8")),), (bytearray("é".encode("latin-1")),)], "c binary")
    assert [r["t"] for r in df.select(corpus.decode_text(F.col("c")).alias("t")).collect()] == ["é", "é"]
    assert df.select(corpus.decode_dropping(F.col("c")).alias("t")).collect()[1]["t"] == ""


def test_answer_repair():
    full = genplan.first_object('x {"a": "br}ace", "b": {"c": 1}} tail {')
    assert full == ('{"a": "br}ace", "b": {"c": 1}}', True)
    assert genplan.first_object("none") is None
    assert genplan.close_object('{"keywords": ["a", "b"], "word_count":') == '{"keywords": ["a", "b"], "word_count": 0}'
    assert genplan.close_object('{"keywords": ["a", "b') == '{"keywords": ["a", "b"]}'
    assert genplan.close_object('{"summary": "x", "keywords":') == '{"summary": "x"}'


def test_answers_and_rejects(spark):
    rows = [(1, '```json\n{"keywords": [" A ", 3, "b"], "summary": " s ", "word_count": 12}\n```'), (2, ""), (3, "no json"), (4, '{"a": [1, }'), (5, "Meta moderation"),
            (6, '{"keywords": "K1, k2", "summary": "it\\\'s", "word_count": }'), (7, '{"summary": "a \\( b", "word_count": 3}')]
    good, bad = genplan.parse_answers(spark.createDataFrame(rows, "id int, answer string"), ["id"])
    g = {r["id"]: r for r in good.collect()}
    assert g[1]["keywords"] == ["a", "3", "b"] and g[1]["summary"] == "s" and g[1]["word_count"] == "12"
    assert g[6]["keywords"] == ["k1", "k2"] and g[6]["summary"] == "it's" and g[6]["word_count"] == "0"
    assert g[7]["summary"] == "a \\( b"
    assert {r["id"]: r["reason"] for r in bad.collect()} == {2: "empty response", 3: "no object found", 4: "unparsable", 5: "moderation flag"}


def test_well_formed_answers_need_no_repair(spark):
    """Answers read in the JVM give what the repair would give, and the plan keeps Python to the broken ones."""
    texts = ['{"keywords": ["A", "b c"], "summary": "one \\n two", "word_count": 7}', 'Sure: {"keywords": "x, y", "summary": "s"} and {more}', '{"summary": "q", "keywords": null, "word_count": null}',
             '{"keywords": ["a", {"b": 1}], "summary": "nested"}', '{"keywords": ["a"], "summary": "br}ace", "word_count": 1.5}', '{"keywords": 5, "summary": 6}', '[{"keywords": ["in"], "summary": "list"}]',
             '"{"keywords": ["quoted"], "summary": "z"}"', "{}", '{"keywords": ["a", null]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, answer string")
    cleaned = df.select("id", genplan.clean_answer(F.col("answer")).alias("c"))
    fast = {r["id"]: r["r"] for r in cleaned.select("id", genplan._read(F.col("c")).alias("r")).collect() if r["r"]}
    slow = {r["id"]: r["r"] for r in cleaned.select("id", F.from_json(genplan._repair(F.col("c")), genplan.ANSWER).alias("r")).collect()}
    assert {0, 1, 2, 7, 8} <= set(fast) and not {3, 4, 9} & set(fast)
    assert all(fast[i] == slow[i] for i in fast)


def test_fallback_summary(spark):
    df = spark.createDataFrame([("Your task is to read. Rates fell today.", "Orig one. Two."), ("Not applicable.", "Orig one. Two."), ("w " * 40, "")], "a string, o string")
    got = [r["s"] for r in df.select(P.fallback_summary(F.col("a"), F.col("o")).alias("s")).collect()]
    assert got == ["Rates fell today.", "Orig one.", " ".join(["w"] * 30)]


def test_token_budget_and_metadata_block(spark):
    df = spark.createDataFrame([(100,), (5000,)], "w int")
    got = [tuple(r) for r in df.select(P.max_tokens(F.col("w")), P.max_tokens(F.col("w"), True)).collect()]
    assert got == [(150, 500), (2000, 7680)]
    assert one(spark, "HUMAN METADATA\n- Genre: News\nskip\n- year: 20:20\nHUMAN TEXT x", P.metadata_block) == {"genre": "News", "year": "20:20"}


def test_corpus_files_and_log(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.txt").write_bytes("caf\xe9\nline".encode("latin-1"))
    (tmp_path / "a" / "y.txt").write_text("  \n")
    (tmp_path / "a" / "z.md").write_text("no")
    t = corpus.scan_texts(spark, str(tmp_path))
    assert t.count() == 2
    kept = corpus.not_blank(t).collect()
    assert len(kept) == 1 and kept[0]["text"] == "café\nline"
    log = str(tmp_path / "log")
    df = spark.createDataFrame([("s1", "DS", None)], "sample string, model string, level string")
    tables.append_log(df, log, ["model", "level", "sample"])
    tables.append_log(df, log, ["model", "level", "sample"])
    rows = tables.read_log(spark, log, ["sample", "model", "level"]).collect()
    assert len(rows) == 2 and (rows[0]["sample"], rows[0]["level"]) == ("s1", "UNKNOWN") and rows[0]["ts"] is not None
    assert tables.first_existing(spark, [str(tmp_path / "no"), log]) == log
