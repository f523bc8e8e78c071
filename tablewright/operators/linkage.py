"""Record linkage: similar pairs, star groups, merges, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocking import account_keys, address_keys, keyed, property_keys, spelling_keys
from ..functions.similarity import account_alike, address_alike, forms, property_alike, spelling_alike
from ..functions.text import header_key, let
from ..sources.shared import written
from ..sources.tables import table


def distinct_values(rows: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
    """Each group's distinct values, with where each was first seen and how often."""
    return rows.filter(F.trim(column) != "").groupBy(*keys, F.trim(column).alias("value")).agg(F.min(order).alias("seq"), F.count("*").alias("n"))


#: Rules by name: the keys that similar values share, and the predicate on the forms of (earlier, later).
RULES = {"property": (property_keys, property_alike), "account": (account_keys, account_alike), "address": (address_keys, address_alike), "spelling": (spelling_keys, spelling_alike)}


#: Values of a group that meet directly: up to about here that is fewer rows than their keys are.
FEW = 400


def pairs(values: DataFrame, keys: list[str], rule: str | Column, few: int = FEW) -> DataFrame:
    """Pairs (a, b, sa, sb) of a group's values, the earlier first, that are similar by a rule of RULES; a Column names each value's. In groups of more than
    `few` values they meet through the keys that similar ones share, and are judged once; there is no product of such a group. Both ways find the same."""
    small, large = _by_size(_formed(_named(values, rule)), keys, few)
    side = lambda v, q: small.select(*keys, F.col("value").alias(v), F.col("seq").alias(q), F.col("_form").alias(f"_{v}"), *(["_rule"] if v == "a" else []))
    found = _alike(side("a", "sa").join(side("b", "sb"), keys).filter("sa < sb"), keys, rule)
    return found if large is None else found.unionByName(_alike(_by_keys(large, keys), keys, rule))


def _named(values: DataFrame, rule: str | Column) -> DataFrame:
    return values.withColumn("_rule", F.lit(rule) if isinstance(rule, str) else rule)


def _formed(named: DataFrame) -> DataFrame:
    """With the form of each value, written: filters on it would be taken before the values are distinct, and make it for every row."""
    return written(named.withColumn("_form", forms(F.col("value"), F.col("_rule"))), "values")


def _by_size(values: DataFrame, keys: list[str], few: int) -> tuple[DataFrame, DataFrame | None]:
    """The values of groups of up to `few`; and those of larger ones and of groups whose key is null, of which nothing is similar, if there are any."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    other = values.groupBy(*keys).agg(F.count("*").alias("_size")).filter(null | (F.col("_size") > few)).select(*[F.col(k).alias(f"_{k}") for k in keys])
    if other.isEmpty():
        return values, None
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return values.join(other, same, "left_anti"), values.join(other, same, "left_semi")


def _judged(by: Column, a: Column, b: Column, rule: str | Column) -> Column:
    """Whether two forms are similar by the rule that `by` names."""
    similar = F.lit(False)
    for name, (_, predicate) in RULES.items():
        if not isinstance(rule, str) or name == rule:
            similar = F.when(by == name, predicate(a, b)).otherwise(similar)
    return similar


def _alike(met: DataFrame, keys: list[str], rule: str | Column) -> DataFrame:
    return met.filter(_judged(F.col("_rule"), F.col("_a"), F.col("_b"), rule)).select(*keys, "a", "b", "sa", "sb")


def _by_keys(named: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs of values that share a key that one looks for and the other is found by."""
    held = named.select(*keys, "value", "seq", "_rule", F.struct("seq", "value", *keys).alias("id"))
    found = written(keyed(held, "_rule", {k: v[0] for k, v in RULES.items()}).select(*[F.col(f"id.{k}").alias(k) for k in keys], F.col("id.value").alias("value"), F.col("id.seq").alias("seq"), F.xxhash64("key").alias("key"), "looks"), "keys")
    side = lambda looks, v, q: found.filter(F.col("looks") if looks else ~F.col("looks")).select(*keys, "key", F.col("value").alias(v), F.col("seq").alias(q))
    met = side(False, "x", "sx").join(side(True, "y", "sy"), [*keys, "key"]).filter("sx <> sy")
    first = F.col("sx") < F.col("sy")
    each = lambda n, p, q: F.when(first, F.col(p)).otherwise(F.col(q)).alias(n)
    once = met.select(*keys, each("a", "x", "y"), each("b", "y", "x"), each("sa", "sx", "sy"), each("sb", "sy", "sx")).distinct()
    form = lambda v: named.select(*keys, F.col("value").alias(v), F.col("_form").alias(f"_{v}"), *(["_rule"] if v == "a" else []))
    return once.join(form("a"), [*keys, "a"]).join(form("b"), [*keys, "b"]).select(*keys, "a", "b", "sa", "sb", "_a", "_b", "_rule")


def star_groups(found: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy groups (keys, seed, value) from pairs (keys, a, b, sa, sb): in the order first seen, a value that is in no group yet takes all later ones, in
    no group yet, that are similar to it. Members needn't be similar to each other.

    So a value is a seed once no earlier similar one is left that isn't taken, and taken once one of them is a seed: each round settles those for whom
    it is clear and drops their pairs, and rounds end when no pair is left. A taken value belongs to its earliest seed. Rounds are as many as the
    longest run of values each of which waits for the one before; only whether any is left comes to the driver.
    """
    found = written(found, "star")
    left = found.select(*keys, "sa", "sb")
    seeds = None
    while not left.isEmpty():
        waiting = left.select(*keys, F.col("sb").alias("sa")).distinct()
        new = written(left.select(*keys, "sa").distinct().join(waiting, [*keys, "sa"], "left_anti"), "star")
        seeds = new if seeds is None else seeds.unionByName(new)
        taken = left.join(new, [*keys, "sa"], "left_semi").select(*keys, F.col("sb").alias("s")).distinct()
        settled = taken.unionByName(new.withColumnRenamed("sa", "s"))
        rest = left.join(settled.withColumnRenamed("s", "sa"), [*keys, "sa"], "left_anti").join(settled.withColumnRenamed("s", "sb"), [*keys, "sb"], "left_anti")
        left = written(rest, "star")
    if seeds is None:
        return found.select(*keys, F.col("a").alias("seed"), F.col("b").alias("value"))
    # pairs of two seeds don't exist, so whoever a seed is similar to is taken by it or by an earlier one
    members = found.join(seeds, [*keys, "sa"]).groupBy(*keys, F.col("b").alias("value")).agg(F.min_by("a", "sa").alias("seed"))
    members = members.select(*keys, "seed", "value")
    return members.unionByName(members.select(*keys, "seed").distinct().withColumn("value", F.col("seed")))


def starred(values: DataFrame, keys: list[str], rule: str | Column, few: int = FEW) -> DataFrame:
    """All values (keys, value, seq, n) with what star_groups makes of their pairs: the seed, null in no group, and how many of the group's values are `starred`
    and how many are `alone`. A group of up to `few` values is one row, and each of its values is compared with the seeds before it only; larger groups
    go by pairs and rounds. Both ways find the same."""
    small, large = _by_size(written(_named(values, rule), "values"), keys, few)
    whole = small.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", "value", "n", "_rule"))).alias("of"))
    marked = whole.select(*keys, F.inline_outer(_folded(F.col("of"), rule)))
    if large is None:
        return marked
    groups = star_groups(_alike(_by_keys(_formed(large), keys), keys, rule), keys)
    rest = large.drop("_rule").join(groups, [*keys, "value"], "left")
    sums = rest.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("seed").alias("starred"), F.count_if(F.col("seed").isNull()).alias("alone"))
    return marked.unionByName(rest.join(sums, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys]))


def _folded(values: Column, rule: str | Column) -> Column:
    """The values (seq, value, n, _rule) of one group in their order, with seed, starred and alone."""
    formed = F.transform(values, lambda v, i: F.struct(i.alias("at"), v["seq"].alias("seq"), v["_rule"].alias("_rule"), forms(v["value"], v["_rule"]).alias("form")))

    def seed_of(seeds: Column, v: Column) -> Column:
        """The place of the earliest seed that is similar; none after it is looked at."""
        return F.aggregate(seeds, F.lit(None).cast("int"), lambda found, s: F.coalesce(found, F.when((s["seq"] < v["seq"]) & _judged(s["_rule"], s["form"], v["form"], rule), s["at"])))

    def taken(state: Column, v: Column) -> Column:
        grown = lambda at: F.when(at.isNull(), F.concat(state["seeds"], F.array(v))).otherwise(state["seeds"])
        return let(seed_of(state["seeds"], v), lambda at: F.struct(grown(at).alias("seeds"), F.concat(state["places"], F.array(F.coalesce(at, v["at"]))).alias("places")))

    def marked(places: Column, members: Column) -> Column:
        grouped = lambda i: (F.get(places, i) != i) | F.array_contains(members, i)
        seeds = F.transform(places, lambda at, i: F.when(grouped(i), F.get(values, at)["value"]))
        return let(seeds, lambda seeds: let(F.size(F.filter(seeds, lambda s: s.isNotNull())).cast("long"), lambda n: F.transform(values, lambda v, i: F.struct(v["value"].alias("value"), v["seq"].alias("seq"), v["n"].alias("n"), F.get(seeds, i).alias("seed"), n.alias("starred"), (F.size(values) - n).alias("alone")))))

    places = let(formed, lambda vs: F.aggregate(vs, F.struct(F.slice(vs, 1, 0).alias("seeds"), F.array().cast("array<int>").alias("places")), taken, lambda state: state["places"]))
    # places of seeds that took others
    return let(places, lambda places: let(F.filter(places, lambda at, i: at != i), lambda members: marked(places, members)))


def _names(spark, sf_dir: str) -> DataFrame:
    """Part names of a brand, as the values of a field."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("field"), F.col("p_name").alias("name"), F.col("p_partkey").alias("at"))


def similar_pairs(spark, sf_dir: str) -> DataFrame:
    values = distinct_values(_names(spark, sf_dir), ["field"], "name", "at")
    return pairs(values, ["field"], "property").select("field", "a", "b", F.levenshtein("a", "b").alias("edits"))


_VALUES = "v AS (SELECT p_brand AS field, trim(p_name) AS value, min(p_partkey) AS seq, count(*) AS n FROM part GROUP BY 1, 2)"
SIMILAR_PAIRS = f"""WITH {_VALUES}, t AS (SELECT *, string_split(value, ' ') AS w FROM v),
p AS (SELECT a.field, a.value AS a, b.value AS b, a.w AS wa, b.w AS wb, len(list_intersect(a.w, b.w)) AS shared, levenshtein(a.value, b.value) AS edits FROM t a JOIN t b ON a.field = b.field AND a.seq < b.seq)
SELECT field, a, b, CAST(edits AS INTEGER) AS edits FROM p WHERE contains(a, b) OR contains(b, a) OR shared >= 1 OR edits <= greatest(3, floor(least(length(a), length(b)) * 0.3))"""


def star_groups_query(spark, sf_dir: str) -> DataFrame:
    values = distinct_values(_names(spark, sf_dir), ["field"], "name", "at")
    return starred(values, ["field"], "property").filter("seed is not null").select("field", "seed", "value")


# Fixed patterns: numbers and money; day and month.
SKIP = (r"^[\d,.\-\s/$%()]+$", r"^\d{1,2}[/\-]\d{1,2}([/\-]\d{2,4})?$")


def skippable(c: Column) -> Column:
    """Short, numeric, money or dates: not worth spell-checking."""
    return (F.char_length(c) < 4) | c.rlike(SKIP[0]) | c.rlike(SKIP[1])


def frequencies(cells: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
    return distinct_values(cells, keys, column, order).filter(~skippable(F.col("value")))


def sanitize_groups(spark, sf_dir: str) -> DataFrame:
    """Misspelt values of each brand's table, with the most frequent spelling as the one to keep, ties to the first seen."""
    values = frequencies(_names(spark, sf_dir), ["field"], "name", "at")
    counted = starred(values, ["field"], "spelling").filter("seed is not null")
    w = Window.partitionBy("field", "seed")
    return counted.select("field", "seed", "value", "n", F.max_by("value", F.struct("n", -F.col("seq"))).over(w).alias("canonical"))


def value_frequency(spark, sf_dir: str) -> DataFrame:
    """Every word of every document that is worth checking, as cells of a table."""
    cells = table(spark, sf_dir, "documents").select(F.lit("text").alias("field"), F.explode(F.split("text", r"[ \n]")).alias("cell"))
    found = cells.select(F.trim("cell").alias("value")).filter((F.col("value") != "") & ~skippable(F.col("value")))
    return found.groupBy("value").agg(F.count("*").alias("n"))


VALUE_FREQUENCY = r"""SELECT value, count(*) AS n FROM (SELECT trim(unnest(regexp_split_to_array(text, '[ \n]'))) AS value FROM documents)
WHERE length(value) >= 4 AND NOT regexp_matches(value, '^[0-9,.\-\s/$%()]+$') GROUP BY value"""

# Import headers by their letters and digits, and the field each fills.
HEADERS = {
    "propertyname": "property_name", "property": "property_name", "providername": "provider_name", "provider": "provider_name",
    "account": "account_number", "accountnumber": "account_number", "accountno": "account_number", "acct": "account_number",
    "serviceenddate": "service_end_date", "billingenddate": "service_end_date", "enddate": "service_end_date",
    "servicestartdate": "service_start_date", "billingstartdate": "service_start_date", "startdate": "service_start_date",
    "currentcharges": "amount", "amount": "amount", "charges": "amount", "totalamount": "amount",
    "utilitytype": "utility_type", "type": "utility_type", "utility": "utility_type", "address": "address",
}


def map_headers(cells: DataFrame) -> DataFrame:
    """Cells (row, header, value) to cells with the field that the header names; unknown headers are dropped."""
    dim = cells.sparkSession.createDataFrame(list(HEADERS.items()), "header_key string, mapped string")
    return cells.withColumn("header_key", header_key(F.col("header"))).join(F.broadcast(dim), "header_key").drop("header_key")


def import_summary(cells: DataFrame, required: list[str]) -> DataFrame:
    """Rows kept (some required field isn't blank), rows skipped, and the fields that were mapped, in order."""
    rows = map_headers(cells).groupBy("row").agg(F.max(F.col("mapped").isin(*required) & (F.trim("value") != "")).alias("kept"), F.collect_set("mapped").alias("fields"))
    return rows.agg(F.count_if("kept").alias("inserted"), F.count_if(~F.col("kept")).alias("skipped"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("fields")))), ",").alias("mapped_fields"))


def import_mapping(spark, sf_dir: str) -> DataFrame:
    """Customers as an import sheet; every sixth row has only blanks where a value is needed."""
    c = table(spark, sf_dir, "customer")
    blank = lambda v: F.when(F.col("c_custkey") % 6 == 0, F.lit(" ")).otherwise(v.cast("string"))
    cell = lambda h, v: F.struct(F.lit(h).alias("header"), v.cast("string").alias("value"))
    cells = c.select(F.col("c_custkey").alias("row"), F.explode(F.array(cell("Property Name", blank(F.col("c_name"))), cell("Account No.", blank(F.col("c_custkey"))), cell("Current Charges", blank(F.col("c_acctbal"))), cell("Utility-Type", F.col("c_mktsegment")), cell("Remarks", F.lit("x")))).alias("x")).select("row", "x.header", "x.value")
    return import_summary(cells, ["property_name", "account_number", "amount"])


IMPORT_MAPPING = "SELECT count(*) FILTER (c_custkey % 6 <> 0) AS inserted, count(*) FILTER (c_custkey % 6 = 0) AS skipped, 'account_number,amount,property_name,utility_type' AS mapped_fields FROM customer"


def community(path: Column) -> Column:
    """The name of a file's folder; (root) without one."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    return F.when(F.size(parts) < 2, F.lit("(root)")).otherwise(F.coalesce(F.nullif(F.element_at(parts, -2), F.lit("")), F.lit("(root)")))


def folder_community(spark, sf_dir: str) -> DataFrame:
    """Pages by the folder of their address, whatever follows the path."""
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[a-z]+://", "")
    return table(spark, sf_dir, "pages").groupBy(community(path).alias("community")).agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


FOLDER_COMMUNITY = r"""WITH p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', ''), '/') AS parts FROM pages)
SELECT CASE WHEN len(parts) < 2 THEN '(root)' ELSE coalesce(nullif(parts[len(parts) - 1], ''), '(root)') END AS community, count(*) AS n_pages, min(page_id) AS first_page FROM p GROUP BY 1"""

def summary(images: DataFrame, rows: DataFrame) -> DataFrame:
    """What an incident workbook says of itself: rows, images read, communities among them, and images that failed. images (path, error), rows (path)."""
    read = images.agg(F.count("*").alias("images"), F.countDistinct(community(F.col("path"))).alias("communities"), F.count("error").alias("errors"))
    return read.join(rows.agg(F.count("*").alias("rows"))).select("rows", "images", "communities", "errors")


def incident_summary(spark, sf_dir: str) -> DataFrame:
    """Pages as images by their address, every thirteenth of which fails; one that doesn't gives a row per paragraph."""
    p = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[a-z]+://", "").alias("path"), "page_id", "html").withColumn("error", F.when(F.col("page_id") % 13 == 0, "unreadable"))
    rows = p.filter("error is null").select("path", F.explode(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).alias("row"))
    return summary(p.select("path", "error"), rows)


INCIDENT_SUMMARY = r"""WITH p AS (SELECT *, string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', ''), '/') AS parts FROM pages)
SELECT CAST(sum(len(regexp_extract_all(html, '<p>'))) FILTER (page_id % 13 <> 0) AS BIGINT) AS rows, count(*) AS images, count(DISTINCT CASE WHEN len(parts) < 2 THEN '(root)' ELSE coalesce(nullif(parts[len(parts) - 1], ''), '(root)') END) AS communities, count(*) FILTER (page_id % 13 = 0) AS errors FROM p"""

# The fields whose values may be merged, and what they are called.
MERGE_FIELDS = {"provider_name": "Provider Name", "property_name": "Property Name", "account_number": "Account Number", "address": "Address"}


def merge_groups(rows: DataFrame, keys: list[str], order: str = "seq", fields: tuple[str, ...] = tuple(MERGE_FIELDS)) -> DataFrame:
    """What a reader may merge among rows (keys, field, value, order): per field the groups of similar values under the field's label, the values in no
    group, if two or more, as (other); without a group all values, if two or more, as (manual). Names and addresses meet by words and
    spelling, accounts by their last digits."""
    values = distinct_values(rows.filter(F.col("field").isin(*fields)), [*keys, "field"], "value", order)
    rule = F.when(F.col("field") == "account_number", "account").when(F.col("field") == "address", "address").otherwise("property")
    on = [*keys, "field"]
    marked = starred(values, on, rule)
    label = F.lit(None).cast("string")
    for f, name in MERGE_FIELDS.items():
        label = F.when(F.col("field") == f, F.lit(name)).otherwise(label)
    tail = F.when(F.col("seed").isNotNull(), "").when(F.col("starred") > 0, " (other)").otherwise(" (manual)")
    return marked.filter(F.col("seed").isNotNull() | (F.col("alone") >= 2)).select(*on, F.concat(label, tail).alias("label"), "seed", "value")


def _offices(spark, sf_dir: str) -> DataFrame:
    """Customers of each nation, three hundred at a time, as bills of one office: five rows of it each. Offices don't grow with the table."""
    c = table(spark, sf_dir, "customer").withColumn("office", F.concat_ws("/", "c_nationkey", F.expr("c_custkey div 300")))
    k = F.col("c_custkey")
    cell = lambda f, v: F.struct(F.lit(f).alias("field"), v.cast("string").alias("value"))
    provider = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("North Power", "NorthPower Co", "City Water", "Gas and Light")]), (k % 4 + 1).cast("int")), F.when(k % 8 < 4, "").otherwise(" LLC"))
    place = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Agave Village", "Agave Villge", "Stonegate Commons", "Zephyr Heights")]), (F.expr("c_custkey div 3 % 4") + 1).cast("int")))
    street = F.concat((k % 3 * 100 + 7).cast("string"), F.lit(" Elm "), F.when(k % 2 == 0, "Street").otherwise("St"), F.lit(" Unit "), F.expr("c_custkey div 7 % 2").cast("string"))
    cells = F.array(cell("provider_name", provider), cell("property_name", place), cell("account_number", F.concat(F.when(k % 2 == 0, "XXXX").otherwise("0098"), F.lpad((k * 37 % 5000).cast("string"), 4, "0"))), cell("address", street), cell("amount", F.col("c_acctbal")))
    return c.select("office", k.alias("seq"), F.explode(cells).alias("x")).select("office", "seq", "x.field", "x.value")


def merge_candidates(spark, sf_dir: str) -> DataFrame:
    """Utility bills: all values of four fields."""
    return merge_groups(_offices(spark, sf_dir), ["office"])


def statement_merge_candidates(spark, sf_dir: str) -> DataFrame:
    """Bank statements: the first value of each of three fields in a file (of ten customers)."""
    rows = _offices(spark, sf_dir).withColumn("file", F.expr("seq div 10"))
    first = rows.filter(F.trim("value") != "").groupBy("office", "file", "field").agg(F.min_by("value", "seq").alias("value"), F.min("seq").alias("seq"))
    return merge_groups(first, ["office"], fields=("property_name", "account_number", "address"))


QUERIES = {
    "merge_candidates": (merge_candidates, None),
    "statement_merge_candidates": (statement_merge_candidates, None),
    "similar_pairs": (similar_pairs, SIMILAR_PAIRS),
    "star_groups": (star_groups_query, None),
    "sanitize_groups": (sanitize_groups, None),
    "value_frequency": (value_frequency, VALUE_FREQUENCY),
    "import_mapping": (import_mapping, IMPORT_MAPPING),
    "folder_community": (folder_community, FOLDER_COMMUNITY),
    "incident_summary": (incident_summary, INCIDENT_SUMMARY),
}
