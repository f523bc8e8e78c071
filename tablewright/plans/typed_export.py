"""Export by document type: each file's type is voted, and its values go into that type's template, in one pass over the fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import parse_number
from ..sources.tables import EXTRACTED, extracted


def typed_export(rows: DataFrame, exclusive: dict[str, str], templates: dict[str, list[str]], numbers: tuple[str, ...], default: str, key: str = "file", order: str = "seq") -> DataFrame:
    """(key, doc_type, columns: array of (field, place, text), data: VARIANT) of long fields (key, field, value, order).

    The type is the one whose exclusive fields are found most often, ties to the first found, `default` without any. Of its template's fields those that
    the file has a value for are columns, in the template's order; the first value that isn't blank counts, as a number where the field's kind and the
    text allow, else as text. Fields are reduced to one row per (key, field) before a file's are gathered, so a file is as large as the number of its fields.
    """
    filled = F.trim("value") != ""
    one = rows.groupBy(key, "field").agg(F.min(F.when(filled, F.struct(F.col(order).alias("o"), F.col("value").alias("v")))).alias("first"), F.count("*").alias("n"), F.min(order).alias("seen"))
    files = one.groupBy(key).agg(F.collect_list(F.struct("field", F.col("first.v").alias("value"), "n", "seen")).alias("fs"))

    kind = F.create_map(*[F.lit(x) for kv in exclusive.items() for x in kv])
    votes = F.filter(F.transform("fs", lambda f: F.struct(kind[f["field"]].alias("t"), f["n"].alias("n"), f["seen"].alias("seen"))), lambda v: v["t"].isNotNull())

    def count(t: str) -> Column:
        own = F.filter(votes, lambda v: v["t"] == t)
        return F.when(F.size(own) > 0, F.struct((-F.aggregate(own, F.lit(0).cast("long"), lambda a, v: a + v["n"])).alias("n"), F.array_min(F.transform(own, lambda v: v["seen"])).alias("seen"), F.lit(t).alias("t")))

    best = F.array_min(F.filter(F.array(*[count(t) for t in dict.fromkeys(exclusive.values())]), lambda x: x.isNotNull()))
    voted = files.select(key, "fs", F.coalesce(best["t"], F.lit(default)).alias("doc_type"))
    places = F.create_map(*[x for t, fs in templates.items() for x in (F.lit(t), F.array(*[F.lit(f) for f in fs]))])[F.col("doc_type")]
    have = F.map_from_entries(F.transform(F.filter("fs", lambda f: f["value"].isNotNull()), lambda f: F.struct(f["field"], f["value"])))
    columns = F.filter(F.transform(places, lambda f, i: F.struct(f.alias("field"), i.alias("place"), F.element_at("have", f).alias("text"))), lambda c: c["text"].isNotNull())
    out = voted.withColumn("have", have).select(key, "doc_type", columns.alias("columns"))

    quoted = lambda t: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(t, r'([\\"])', r"\\$1"), r"[\x00-\x1f]", " "), F.lit('"'))
    number = lambda c: F.when(c["field"].isin(*numbers), parse_number(c["text"]))
    said = F.transform("columns", lambda c: F.concat(quoted(c["field"]), F.lit(":"), F.coalesce(number(c).cast("decimal(18,2)").cast("string"), quoted(c["text"]))))
    return out.withColumn("data", F.parse_json(F.concat(F.lit("{"), F.array_join(said, ","), F.lit("}"))))


def schemas(exported: DataFrame) -> DataFrame:
    """(doc_type, n_files, schema): the fields that a type's files have, and of what kinds, whatever they are."""
    return exported.groupBy("doc_type").agg(F.count("*").alias("n_files"), F.schema_of_variant_agg("data").alias("schema"))


def write_by_type(exported: DataFrame, path: str, key: str = "file") -> None:
    """A folder per type, in one pass; a type's files are read with spark.read.parquet(path + "/doc_type=...")."""
    exported.select("doc_type", key, F.to_json("data").alias("data")).write.mode("overwrite").partitionBy("doc_type").parquet(path)


#: The event types as fields: what tells a type, and what its template shows.
EXCLUSIVE = {"purchase": "utility_bill", "signup": "lease", "error": "lease"}
TEMPLATES = {"utility_bill": ["purchase", "view", "click"], "lease": ["signup", "purchase", "view"], "bank_statement": ["click", "view"]}
NUMBERS = ("view", "purchase")


def _fields(spark, sf_dir: str) -> DataFrame:
    """A user's first days as files; views and purchases are numbers, some of them with words after."""
    rows = extracted(spark, sf_dir).withColumn("file", F.concat_ws(":", "file", F.expr("page div 5")))
    number = F.col("field").isin(*NUMBERS) & (F.col("value") != "")
    return rows.withColumn("value", F.when(number, F.concat(F.substr("value", F.lit(2)), F.when(F.col("seq") % 4 == 0, " kWh").otherwise(""))).otherwise(F.col("value")))


def _exported(spark, sf_dir: str) -> DataFrame:
    return typed_export(_fields(spark, sf_dir), EXCLUSIVE, TEMPLATES, NUMBERS, "bank_statement")


def typed_export_query(spark, sf_dir: str) -> DataFrame:
    out = _exported(spark, sf_dir).select("file", "doc_type", F.explode("columns").alias("c"), "data")
    return out.select("file", "doc_type", "c.field", "c.place", "c.text", F.try_variant_get("data", F.concat(F.lit("$."), F.col("c.field")), "double").alias("number"))


_CASES = " ".join(f"WHEN '{t}' THEN list_position({fs}, field)" for t, fs in TEMPLATES.items())
_TYPED = f"""{EXTRACTED}, f AS (SELECT seq, file || ':' || (page // 5) AS file, field, CASE WHEN field IN {NUMBERS} AND value <> '' THEN substr(value, 2) || CASE WHEN seq % 4 = 0 THEN ' kWh' ELSE '' END ELSE value END AS value FROM extracted),
kinds AS (SELECT file, CASE field {" ".join(f"WHEN '{k}' THEN '{t}'" for k, t in EXCLUSIVE.items())} END AS t, count(*) AS n, min(seq) AS seen FROM f GROUP BY 1, 2),
vote AS (SELECT DISTINCT f.file, coalesce(k.t, 'bank_statement') AS doc_type FROM f LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, seen) AS r FROM kinds WHERE t IS NOT NULL) k ON k.file = f.file AND r = 1),
firsts AS (SELECT file, field, arg_min(value, seq) AS text FROM f WHERE trim(value) <> '' GROUP BY 1, 2),
placed AS (SELECT file, doc_type, field, CAST(CASE doc_type {_CASES} END AS INTEGER) - 1 AS place, text FROM firsts JOIN vote USING (file))"""
TYPED_EXPORT = f"""WITH {_TYPED} SELECT file, doc_type, field, place, text, CASE WHEN field IN {NUMBERS} THEN CAST(regexp_extract(text, '^[0-9]+') AS DOUBLE) END AS number FROM placed WHERE place >= 0"""


def typed_export_schema(spark, sf_dir: str) -> DataFrame:
    """Numbers' digits are left out, as they grow with the values."""
    return schemas(_exported(spark, sf_dir)).withColumn("schema", F.regexp_replace("schema", r"\(\d+,\d+\)", ""))


TYPED_EXPORT_SCHEMA = f"""WITH {_TYPED}, s AS (SELECT doc_type, string_agg(DISTINCT field || ': ' || CASE WHEN field IN {NUMBERS} THEN 'DECIMAL' ELSE 'STRING' END, ', ' ORDER BY field || ': ' || CASE WHEN field IN {NUMBERS} THEN 'DECIMAL' ELSE 'STRING' END) AS fields FROM placed WHERE place >= 0 GROUP BY 1)
SELECT doc_type, count(*) AS n_files, any_value('OBJECT<' || fields || '>') AS schema FROM vote JOIN s USING (doc_type) GROUP BY doc_type"""

QUERIES = {"typed_export": (typed_export_query, TYPED_EXPORT), "typed_export_schema": (typed_export_schema, TYPED_EXPORT_SCHEMA)}
