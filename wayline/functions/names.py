"""Metadata carried by file names and paths, as column expressions.

Names look like ``<Domain>_<Field>_<AuthorID>_<Year>_<ItemIndex>[_<Model>_<LVn>].txt``;
the domain-level corpus drops the author part. Values stay strings; a name that
does not match gives a NULL struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Provider -> short tag used in file names.
MODEL_TAGS = {
    "DEEPSEEK": "DS",
    "GEMMA_4B": "G4B",
    "GEMMA_12B": "G12B",
    "LLAMA_MAVRICK": "LMK",
}
DEFAULT_TAG = "DS"

# File-name grammars.
HUMAN_NAME = r"^([A-Za-z]+)_([A-Za-z0-9_]+)_(\d+)_(\d{4})_(\d+)\.txt$"
MODEL_NAME = r"^([A-Za-z]+)_([A-Za-z0-9_]+)_(\d+)_(\d{4})_(\d+)_([A-Z0-9]+)_(LV[123])\.txt$"
PATH_NAME = r"^([A-Za-z]+)_([A-Za-z0-9]+)_(\d+)_(\d{4})_(\d+)\.txt$"
DOMAIN_HUMAN_NAME = r"^([A-Za-z]+)_([A-Za-z0-9]+)_(\d{4})_(\d+)\.txt$"
DOMAIN_MODEL_NAME = r"^([A-Za-z]+)_([A-Za-z0-9]+)_(\d{4})_(\d+)_([A-Z0-9]+)_(LV[123])\.txt$"
AUTHOR_KEY_HUMAN = r"^([A-Za-z]+)_([A-Za-z0-9]+)_(\d{2,})_(\d{4})_(\d{2,})\.txt$"
AUTHOR_KEY_MODEL = r"^([A-Za-z]+)_([A-Za-z0-9]+)_(\d{2,})_(\d{4})_(\d{2,})_([A-Za-z0-9]+)_LV(\d+)\.txt$"
FLAGGED_NAME = r"^News_(\w+)_[A-Z0-9]+_LV(\d)_(\d{4})_(\d{2})\.txt$"
FLAGGED_DIR = r"/News/([^/]+)/(\d{4})/"

KNOWN_GENRES = ["news", "blogs", "academic"]
HUMAN_DIRS = ["Human", "cleaned_human", "human"]



def _null_str() -> Column:
    return F.lit(None).cast("string")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _with_extension(name: Column) -> Column:
    return F.when(F.endswith(name, F.lit(".txt")), name).otherwise(F.concat(name, F.lit(".txt")))


def _groups(name: Column, pattern: str, n: int) -> Column:
    """All groups of one match as an array (one regex pass), NULL without a match."""
    sep = "\x1f"
    joined = F.regexp_replace(name, pattern, sep.join(f"${i}" for i in range(1, n + 1)))
    return F.when(name.rlike(pattern), F.split(joined, sep))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; keeps the generated code small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _struct(groups: Column, *fields: Column) -> Column:
    return F.when(groups.isNotNull(), F.struct(*fields))


def human_name(filename: Column) -> Column:
    """Struct of a human file name, or NULL."""
    return _let(_groups(_with_extension(filename), HUMAN_NAME, 5), lambda g: _struct(
        g, F.lower(g[0]).alias("domain"), g[1].alias("field"), g[2].alias("author_id"),
        g[3].alias("year"), g[4].alias("item_index"), _null_str().alias("model"), _null_str().alias("level"),
    ))


def model_name(filename: Column) -> Column:
    """Struct of a machine-written file name, or NULL."""
    return _let(_groups(_with_extension(filename), MODEL_NAME, 7), lambda g: _struct(
        g, F.lower(g[0]).alias("domain"), g[1].alias("field"), g[2].alias("author_id"),
        g[3].alias("year"), g[4].alias("item_index"), g[5].alias("model"), g[6].alias("level"),
    ))


def any_name(filename: Column) -> Column:
    """Human grammar first, then the machine grammar."""
    return F.coalesce(human_name(filename), model_name(filename))


def path_meta(path: Column) -> Column:
    """Genre, subfield, batch, year and index of a human path.

    The genre directory follows the human directory. A name outside the grammar
    falls back to the first four digits of the path, the directory below the
    genre and batch/index "01". No human directory gives NULL.
    """
    parts = F.split(path, "/")
    anchor = F.coalesce(*[F.nullif(F.array_position(parts, d), F.lit(0)) for d in HUMAN_DIRS]).cast("int")
    year = F.regexp_extract(path, r"(\d{4})", 1)

    def build(c):
        genre_dir, sub_dir, g = c["genre_dir"], c["sub_dir"], c["g"]
        hit = g.isNotNull()
        return F.when(genre_dir.isNotNull(), F.struct(
            F.lower(genre_dir).alias("genre"),
            F.when(hit, F.lower(g[1])).otherwise(F.coalesce(F.lower(sub_dir), F.lit("unknown"))).alias("subfield"),
            F.when(hit, g[2]).otherwise("01").alias("batch"),
            F.when(hit, g[3]).otherwise(F.when(c["year"] == "", "0000").otherwise(c["year"])).alias("year"),
            F.when(hit, g[4]).otherwise("01").alias("index"),
        ))

    return _let(
        F.struct(
            F.get(parts, anchor).alias("genre_dir"), F.get(parts, anchor + 1).alias("sub_dir"),
            _groups(basename(path), PATH_NAME, 5).alias("g"), year.alias("year"),
        ),
        build,
    )


def _domain_path(path: Column, anchor_dir: str, pattern: str, with_model: bool) -> Column:
    parts = F.split(path, "/")
    anchor = F.nullif(F.array_position(parts, anchor_dir), F.lit(0)).cast("int")

    def build(c):
        g, genre_dir = c["g"], c["genre_dir"]
        error = (
            F.when(c["anchor"].isNull(), f"no {anchor_dir} directory")
            .when(genre_dir.isNull(), "unexpected path structure")
            .when(g.isNull(), "file name does not match the grammar")
        )
        known = F.lower(g[0]).isin(KNOWN_GENRES)
        values = {
            "genre": F.when(known, F.lower(g[0])).otherwise(F.lower(genre_dir)),
            "subfield": F.lower(g[1]), "batch": F.lit("01"), "year": g[2], "index": g[3],
            "model": F.upper(g[4]) if with_model else _null_str(),
            "level": F.upper(g[5]) if with_model else _null_str(),
        }
        ok = genre_dir.isNotNull() & g.isNotNull()
        return F.struct(*[F.when(ok, v).alias(k) for k, v in values.items()], error.alias("error"))

    return _let(
        F.struct(
            anchor.alias("anchor"), F.get(parts, anchor).alias("genre_dir"),
            _groups(basename(path), pattern, 6 if with_model else 4).alias("g"),
        ),
        build,
    )


def domain_human_path(path: Column) -> Column:
    """Domain-level human path (no author); ``error`` says why a path is rejected."""
    return _domain_path(path, "human", DOMAIN_HUMAN_NAME, with_model=False)


def domain_model_path(path: Column) -> Column:
    """Domain-level machine path; ``error`` says why a path is rejected."""
    return _domain_path(path, "llm", DOMAIN_MODEL_NAME, with_model=True)


def quarantine(df: DataFrame, meta: str) -> tuple[DataFrame, DataFrame]:
    """Split rows into parsed ones and rejected ones by the struct's error."""
    return df.where(F.col(f"{meta}.error").isNull()), df.where(F.col(f"{meta}.error").isNotNull())


def dispatch_meta(path: Column, is_model: bool) -> Column:
    """Domain-level parser under ``macro_dataset``, else (or on error) the name grammar."""
    name = basename(path)
    by_name = model_name(name) if is_model else any_name(name)
    macro = domain_model_path(path) if is_model else domain_human_path(path)
    in_macro = F.array_contains(F.split(path, "/"), "macro_dataset")

    def as_meta(m):
        return F.when(m["error"].isNull(), F.struct(
            m["genre"].alias("domain"), m["subfield"].alias("field"), m["batch"].alias("author_id"),
            m["year"].alias("year"), m["index"].alias("item_index"), m["model"].alias("model"), m["level"].alias("level"),
        ))

    return F.coalesce(F.when(in_macro, _let(macro, as_meta)), by_name)


def composite_author(path: Column) -> Column:
    """Author key ``provider_LVn_domain_field_author`` (or ``human_...``) with its parts."""
    name = basename(path)

    def build(c):
        m, h = c["m"], c["h"]
        by_model = F.struct(
            F.lit("llm").alias("label"), m[3].cast("int").alias("year"), m[5].alias("provider"),
            m[6].cast("int").alias("level"),
            F.concat_ws("_", m[5], F.concat(F.lit("LV"), m[6]), m[0], m[1], m[2]).alias("author"),
        )
        by_human = F.struct(
            F.lit("human").alias("label"), h[3].cast("int").alias("year"), F.lit("human").alias("provider"),
            F.lit(0).alias("level"), F.concat_ws("_", F.lit("human"), h[0], h[1], h[2]).alias("author"),
        )
        return F.when(m.isNotNull(), by_model).when(h.isNotNull(), by_human)

    return _let(
        F.struct(_groups(name, AUTHOR_KEY_MODEL, 7).alias("m"), _groups(name, AUTHOR_KEY_HUMAN, 5).alias("h")), build
    )


def split_author(author: Column) -> Column:
    """Take a composite author key apart again."""

    def build(p):
        is_model = p[0].isin(list(MODEL_TAGS.values()))
        shift = F.when(is_model, 2).when(p[0] == "human", 1).otherwise(0)
        part = lambda i: F.get(p, shift + i)
        digits = F.when(part(2).rlike(r"^\d+$"), part(2)).try_cast("int")
        return F.struct(
            F.when(is_model, p[0]).alias("model"),
            F.when(is_model, F.regexp_replace(F.get(p, F.lit(1)), "LV", "").try_cast("int")).alias("level"),
            F.lower(part(0)).alias("domain"), part(1).alias("field"), digits.alias("author_id"),
            is_model.alias("is_llm"),
        )

    return _let(F.split(author, "_"), build)


def token_meta(filename: Column) -> Column:
    """Metadata by token position: five parts at least, seven for model and level."""

    def build(p):
        enough, full = F.size(p) >= 5, F.size(p) >= 7
        at = lambda i: F.get(p, F.lit(i))
        return F.struct(
            F.when(enough, F.lower(at(0))).alias("domain"),
            F.when(enough, at(1)).alias("field"),
            F.when(enough, at(2)).alias("author_id"),
            F.when(enough & at(3).rlike(r"^\d{4}$"), at(3)).alias("year"),
            F.when(enough & at(4).rlike(r"^\d+$"), at(4)).alias("item_index"),
            F.when(full, at(5)).alias("model"),
            F.when(full, at(6)).alias("level"),
        )

    return _let(F.split(F.regexp_replace(filename, r"\.txt", ""), "_"), build)


def first_year_token(filename: Column) -> Column:
    """First ``_``-separated token made of exactly four digits."""
    return F.get(F.filter(F.split(filename, "_"), lambda t: t.rlike(r"^[0-9]{4}$")), F.lit(0)).cast("int")


def first_year_run(filename: Column, delimited: bool = False) -> Column:
    """First run of four digits (or one enclosed in underscores)."""
    y = F.regexp_extract(filename, r"_(\d{4})_" if delimited else r"(\d{4})", 1)
    return F.when(y != "", y).cast("int")


def year_and_index(filename: Column) -> Column:
    """Year and item index used for ordering; the whole index is kept."""
    pattern = r"(\d{4})_(\d{2,})"
    g = lambda i: F.regexp_extract(filename, pattern, i)
    return F.when(
        filename.rlike(pattern),
        F.struct(g(1).cast("int").alias("year"), g(2).cast("int").alias("item_index")),
    )


def provider_tag(provider: Column) -> Column:
    tags = F.create_map(*[F.lit(x) for kv in MODEL_TAGS.items() for x in kv])
    return F.coalesce(tags[F.upper(provider)], F.lit(DEFAULT_TAG))


def _capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def build_name(genre: Column, subfield: Column, batch: Column, year: Column, index: Column,
               level: Column, provider: Column) -> Column:
    """Output file name; blogs and academic upper-case the field, news lower-cases it."""
    g = F.lower(genre)
    field = (
        F.when(g.isin("blogs", "academic"), F.upper(subfield))
        .when(g == "news", F.lower(subfield))
        .otherwise(_capitalize(subfield))
    )
    tag = F.concat_ws("_", provider_tag(provider),
                      F.when(level.isNotNull() & (level != 0), F.concat(F.lit("LV"), level.cast("string"))))
    return F.concat(
        F.concat_ws("_", _capitalize(genre), field, F.coalesce(batch, F.lit("01")), year, index, tag),
        F.lit(".txt"),
    )


def build_domain_name(genre: Column, subfield: Column, year: Column, index: Column,
                      level: Column, provider: Column) -> Column:
    """Domain-level output file name: no author part, same field casing."""
    g = F.lower(genre)
    field = (
        F.when(g.isin("blogs", "academic"), F.upper(subfield))
        .when(g == "news", F.lower(subfield))
        .otherwise(_capitalize(subfield))
    )
    return F.concat(
        F.concat_ws("_", _capitalize(genre), field, year, index, provider_tag(provider),
                    F.concat(F.lit("LV"), level.cast("string"))),
        F.lit(".txt"),
    )


def identifier(genre: Column, subfield: Column, year: Column, index: Column) -> Column:
    """Identifier label; blank parts are left out."""
    blank = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    return F.concat_ws("_", _capitalize(genre), F.coalesce(blank(subfield), F.lit("unknown")), blank(year), blank(index))


def flagged_meta(path: Column) -> Column:
    """Period, year, index and level of a stored news output; the directory wins."""
    name = basename(path)
    d = lambda i: F.nullif(F.regexp_extract(path, FLAGGED_DIR, i), F.lit(""))
    n = lambda i: F.regexp_extract(name, FLAGGED_NAME, i)
    return F.when(
        name.rlike(FLAGGED_NAME),
        F.struct(
            F.coalesce(d(1), n(1)).alias("period"), F.coalesce(d(2), n(3)).alias("year"),
            n(4).alias("idx"), n(2).cast("int").alias("level"),
        ),
    )
