"""Planning and auditing of corpus generation: what to write, what exists, what came back."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from wayline.functions import names as N
from wayline.functions import prompts as P
from wayline.session import materialize


def expected_outputs(docs: DataFrame, levels: list[int], provider: str, domain_level: bool = False) -> DataFrame:
    """One row per document and level with the output name; ``docs`` has genre, subfield, batch, year, index."""
    c = F.col
    rows = docs.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    name = (
        N.build_domain_name(c("genre"), c("subfield"), c("year"), c("index"), c("level"), F.lit(provider)) if domain_level
        else N.build_name(c("genre"), c("subfield"), c("batch"), c("year"), c("index"), c("level"), F.lit(provider))
    )
    return rows.withColumn("filename", name)


def pending(expected: DataFrame, existing: DataFrame, key: str = "filename") -> DataFrame:
    """Expected outputs that do not exist yet."""
    return expected.join(existing.select(key).distinct(), key, "left_anti")


def work_plan(expected: DataFrame, existing: DataFrame, key: str = "filename") -> DataFrame:
    """To process, already there and total per level, in one join."""
    have = existing.select(key).distinct().withColumn("_have", F.lit(True))
    j = expected.join(have, key, "left")
    return j.groupBy("level").agg(
        F.count_if(F.col("_have").isNull()).alias("to_process"), F.count_if(F.col("_have")).alias("existing"), F.count(F.lit(1)).alias("total"))


def extraction_requests(docs: DataFrame, model: str) -> DataFrame:
    """System and user prompt per (path, level), each once; templates are a small dimension table."""
    spark = docs.sparkSession
    dim = spark.createDataFrame(P.template_rows(P.EXTRACTION), "_genre string, _level int, system_prompt string")
    d = docs.dropDuplicates(["path", "level"]).withColumn("_g", F.concat(F.upper(F.substring("genre", 1, 1)), F.lower(F.substr("genre", F.lit(2)))))
    c = F.col
    j = d.join(F.broadcast(dim), (c("_g") == c("_genre")) & (c("level") == c("_level")))
    user = P.extraction_request(c("_g"), c("subfield"), c("year"), c("level"), F.lit(model),
                                N.identifier(c("genre"), c("subfield"), c("year"), c("index")), c("text"))
    return j.withColumn("user_prompt", user).drop("_g", "_genre", "_level")


def generation_requests(rows: DataFrame) -> DataFrame:
    """Generation prompt per row with keywords, summary and word_count."""
    spark = rows.sparkSession
    dim = spark.createDataFrame(P.template_rows(P.PREAMBLES), "_genre string, _level int, _preamble string")
    c = F.col
    d = rows.withColumn("_g", F.concat(F.upper(F.substring("genre", 1, 1)), F.lower(F.substr("genre", F.lit(2)))))
    j = d.join(F.broadcast(dim), (c("_g") == c("_genre")) & (c("level") == c("_level")))
    prompt = P.generation_request(c("_g"), c("_preamble"), c("subfield"), c("year"), c("keywords"), c("summary"), c("word_count"))
    return j.withColumn("prompt", prompt).drop("_g", "_genre", "_level", "_preamble")


ANSWER = T.StructType([
    T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("summary", T.StringType()), T.StructField("word_count", T.StringType())])
_KEYS = re.compile(r'"(?:[^"\\]|\\.)*"')


def _outside_strings(text: str):
    """Yield (position, character) of the characters outside string literals."""
    inside = escaped = False
    for i, ch in enumerate(text):
        if inside:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                inside = False
        elif ch == '"':
            inside = True
        else:
            yield i, ch


def first_object(text: str) -> tuple[str, bool] | None:
    """First balanced object, or the open rest and False; None without a brace."""
    start = text.find("{")
    if start < 0:
        return None
    depth = 0
    for i, ch in _outside_strings(text[start:]):
        depth += (ch == "{") - (ch == "}")
        if depth == 0:
            return text[start:start + i + 1], True
    return text[start:], False


def close_object(text: str) -> str:
    """Close a truncated object: default word_count, drop a dangling key or comma, close quotes and brackets."""
    t = text.rstrip()
    if len(_KEYS.sub("", t).split('"')) % 2 == 0:
        t += '"'
    t = re.sub(r'"word_count"\s*:?\s*$', '"word_count": 0', t)
    t = re.sub(r',?\s*"(?:[^"\\]|\\.)*"\s*:\s*$', "", t).rstrip().rstrip(",").rstrip()
    closers = []
    for _, ch in _outside_strings(t):
        if ch in "{[":
            closers.append("}" if ch == "{" else "]")
        elif ch in "}]" and closers:
            closers.pop()
    return t + "".join(reversed(closers))


@pandas_udf(T.StringType())
def _repair(cleaned: pd.Series) -> pd.Series:
    def one(text):
        if text is None:
            return None
        found = first_object(text)
        if found is None:
            return None
        body, complete = found
        if not complete:
            body = close_object(body)
        body = re.sub(r'"word_count"\s*:?\s*([,}])', r'"word_count": 0\1', body)
        try:
            value = json.loads(body, strict=False)
        except ValueError:
            return None
        if not isinstance(value, dict):
            return None
        if isinstance(value.get("keywords"), str):
            value["keywords"] = value["keywords"].split(",")
        elif not isinstance(value.get("keywords"), list):
            value["keywords"] = []
        return json.dumps(value)

    return cleaned.map(one)


# Marks of a code fence, escapes that models write by mistake, and phrases of a refusal.
FENCE = "```(json)?"
BLANKS = r"\\[tn]"
QUOTE = r"\\'"
REFUSALS = "Meta moderation|not generated"
#: A backslash that begins no escape of the format.
STRAY = r'\\(?!["\\/bfnrtu])'
#: The first object if it holds no other and no brace in a string.
FLAT = r"^[^{]*(\{[^{}]*\})"


def clean_answer(answer: Column) -> Column:
    """The answer without fences, with mistaken escapes resolved and objects taken out of quotes.

    Fences go before escapes are read, and a backslash that means nothing is made a written one.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(answer, FENCE, ""), BLANKS, " "), QUOTE, "'")
    written = F.regexp_replace(P.strip_space(bare), STRAY, r"\\\\")
    return F.regexp_replace(F.regexp_replace(written, r'"(?=\{)', ""), r'(?<=\})"', "")


def _read(text: Column) -> Column:
    """The record in a well-formed flat object, read in the JVM; NULL where that does not say all and the repair must look."""
    v = F.try_parse_json(F.nullif(F.regexp_extract(text, FLAT, 1), F.lit("")))
    names = F.try_variant_get(v, "$.keywords", "array<string>")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.keywords", "variant"))
    joined = F.when(kind == "STRING", F.try_variant_get(v, "$.keywords", "string"))
    count, summary = F.try_variant_get(v, "$.word_count", "string"), F.try_variant_get(v, "$.summary", "string")
    # Nested values, numbers with a point and the like are left to the repair.
    plain = F.coalesce(count, F.lit("0")).rlike(r"^-?\d+$") & (names.isNotNull() | ~F.coalesce(kind, F.lit("")).rlike("^(ARRAY|OBJECT)")) & ~F.coalesce(summary, F.lit("")).rlike(r"^[\[{]")
    known = v.isNotNull() & plain & F.forall(F.coalesce(names, F.array().cast("array<string>")), lambda k: k.isNotNull() & ~k.rlike(r"^[\[{]"))
    keywords = F.coalesce(names, F.split(joined, ","), F.array().cast("array<string>"))
    return F.when(known, F.struct(keywords.alias("keywords"), summary.alias("summary"), count.alias("word_count")))


def parse_answers(df: DataFrame, keys: list[str], answer: str = "answer") -> tuple[DataFrame, DataFrame]:
    """(parsed, rejected): records with normalised keywords, summary and raw word_count; rejects carry a reason.

    Well-formed answers are read in the JVM. Only the others go through the repair, in a branch of its own; both outputs read the
    one table that is kept of the result.
    """
    c = df.select(*keys, answer, clean_answer(F.col(answer)).alias("_c"))
    pre = F.when(F.coalesce(F.col(answer), F.lit("")).rlike(r"^\s*$"), "empty response").when(F.col("_c").rlike(REFUSALS), "moderation flag").when(~F.contains(F.col("_c"), F.lit("{")), "no object found")
    c = c.withColumn("reason", pre).withColumn("_r", F.when(F.col("reason").isNull(), _read(F.col("_c"))))
    broken = F.col("reason").isNull() & F.col("_r").isNull()
    columns = [*keys, answer, "reason", "_r"]
    mended = c.where(broken).withColumn("_r", F.from_json(_repair(F.col("_c")), ANSWER)).withColumn("reason", F.when(F.col("_r").isNull(), "unparsable"))
    result = materialize(c.where(~broken).select(*columns).union(mended.select(*columns)))
    good = result.where("reason IS NULL").select(
        *keys, P.normal_keywords(F.col("_r.keywords")).alias("keywords"), P.strip_space(F.coalesce("_r.summary", F.lit(""))).alias("summary"),
        F.col("_r.word_count").alias("word_count"))
    return good, result.where("reason IS NOT NULL").select(*keys, "reason", answer)


def flag_report(outputs: DataFrame, phrase: str, groups: list[str], text: str = "text") -> DataFrame:
    return outputs.groupBy(*groups).agg(F.count_if(F.contains(F.col(text), F.lit(phrase))).alias("flagged"), F.count(F.lit(1)).alias("total"))


def flagged_sources(flagged: DataFrame, sources: DataFrame) -> DataFrame:
    """Source of every flagged output by (period, year, idx); the first path wins.

    ``sources``: period, year, idx, path (any author).
    """
    first = sources.groupBy("period", "year", "idx").agg(F.min("path").alias("source_path"))
    return flagged.join(first, ["period", "year", "idx"], "left")


def run_statistics(log: DataFrame, statuses: list[str]) -> DataFrame:
    """Counts per level and status."""
    return log.groupBy("level").pivot("status", statuses).count().fillna(0, subset=statuses)


