"""Secret scan: fixed patterns, and windows of high Shannon entropy."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import or_empty, table

# Fixed values of the base rules, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Strings looked at by entropy.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Runs of hex digits inside a candidate, in parts of eight or more joined by one dash; judged before the rest is.
HEX_RUN = r"(?=[0-9A-Fa-f_-]{20})[0-9A-Fa-f]{8,}+(?:[_-][0-9A-Fa-f]{8,}+)*+"
# Repeated groups are possessive: Java's regex would else recurse once per repeat and overflow the stack on a long match.
#: Names, paths and dashed words before the value, and after it, read backwards.
LEAD = r"^=*+(?:(?:[A-Z]?[a-z]++|[A-Z]++)[0-9]{0,4}+[/_=-]++)*+"
TAIL_BACKWARDS = r"^(?:[0-9]{0,4}+(?:[a-z]++[A-Z]?|[A-Z]++)[/_=-]++)*+"
WINDOW = 20
#: Character class, as the alphabet counted, to the least entropy in bits of some window. 20 even draws of 16 characters
#: give 3.5 bits on average, of 62 4.1; at most log2(20) = 4.32.
CLASSES = {"hex": ("0123456789abcdef", 3.0), "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.7)}
#: Runs that are known not to be secrets: without digit, or without letter; repeats of one character; UUIDs; paths
#: and dashed words; example and placeholder values.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"(.)\1{7}",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?:/?[A-Za-z]++[0-9]{0,4}+[/_-])++[A-Za-z]*+[0-9]{0,4}+$",
    r"(?i)(example|placeholder|changeme|xxxx|dummy|sample)",
)


#: Matches whose positions are summed up at a time.
STRIDE = 128
SPANS = "array<struct<start:int,kind:int,end:int,match:string>>"


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parts(text: Column, pattern: str, hit) -> Column:
    """The text as an array of (between, match, hit): the leftmost non-overlapping matches, each after what stands before it, and
    whether hit(match) holds; the last one has no match."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.zip_with(between, found, lambda b, m: F.struct(b.alias("between"), m.alias("match"), F.when(m.isNull(), False).otherwise(hit(m)).alias("hit")))


def spans_of(found: Column, kind: int) -> Column:
    """Array of (start, kind, end, match) of the hits among parts, in code points. Positions are running sums, first within strides
    of the matches, then over the strides, as appending to an array copies it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc, x):
        at = acc["at"] + F.char_length(x["between"])
        end = at + F.coalesce(F.char_length(x["match"]), F.lit(0))
        one = F.array(F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("match")))
        return F.struct(end.alias("at"), F.when(x["hit"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def join(acc, x):
        return F.struct((acc["at"] + x["at"]).alias("at"), F.when(F.size(x["out"]) == 0, acc["out"]).otherwise(F.concat(acc["out"], moved(x["out"], acc["at"]))).alias("out"))

    def strides(all_parts):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_parts) - 1) / STRIDE).cast("int")), lambda k: F.aggregate(F.slice(all_parts, k * STRIDE + 1, F.lit(STRIDE)), start, step))

    return F.aggregate(_let(found, strides), start, join, lambda acc: acc["out"])


def moved(found: Column, by: Column) -> Column:
    return F.transform(found, lambda y: F.struct((y["start"] + by).alias("start"), y["kind"].alias("kind"), (y["end"] + by).alias("end"), y["match"].alias("match")))


def spans(text: Column, pattern: str, kind: int, hit=lambda m: F.lit(True)) -> Column:
    """As spans_of the text's parts; texts without a match cost one search only."""
    return F.when(text.rlike(pattern), spans_of(parts(text, pattern, hit), kind)).otherwise(F.array().cast(SPANS))


def blanked(found: Column) -> Column:
    """The text of the parts, each hit as so many blanks."""
    return F.array_join(F.transform(found, lambda x: F.concat(x["between"], F.when(x["hit"], F.repeat(F.lit(" "), F.char_length(x["match"]))).otherwise(F.coalesce(x["match"], F.lit(""))))), "")


def window_entropy(s: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The greatest Shannon entropy, in bits, of any `window` (at most 31) characters of s in a row, from counts kept as the window
    slides: the entering and the leaving character each change one count, and with it the sum of c * log2(c). Zero for
    shorter strings. Characters outside the alphabet share one more count. Counts take 5 bits each, 12 in a long."""
    if not 0 < window < 32:
        raise ValueError("a window has 1 to 31 characters")
    term = F.array(*[F.lit(c * log2(c) if c > 1 else 0.0) for c in range(window + 2)])
    chars = F.transform(F.split(s, ""), lambda c: F.when(F.instr(F.lit(alphabet), c) > 0, F.instr(F.lit(alphabet), c) - 1).otherwise(len(alphabet)))
    longs = [f"c{k}" for k in range(len(alphabet) // 12 + 1)]
    zero = F.struct(*[F.lit(0).cast("long").alias(k) for k in longs], F.lit(0.0).alias("sum"), F.lit(1e9).alias("least"), F.lit(0).alias("at"))

    def slide(all_chars):
        def step(acc, c):
            leaves = F.when(acc["at"] >= window, F.get(all_chars, acc["at"] - window)).otherwise(-1)
            place = lambda x: (F.floor(x / 12).cast("int"), (x % 12) * 5)
            (kc, bc), (kl, bl) = place(c), place(leaves)

            def count(k, bits):
                held = F.lit(0).cast("long")
                for i, name in reversed(list(enumerate(longs))):
                    held = F.when(k == i, acc[name]).otherwise(held)
                return F.call_function("shiftright", held, bits).bitwiseAND(F.lit(31)).cast("int")

            one = lambda bits: F.call_function("shiftleft", F.lit(1).cast("long"), bits)
            up, down = count(kc, bc), count(kl, bl)
            changed = F.get(term, up + 1) - F.get(term, up) + F.when(leaves >= 0, F.get(term, down - 1) - F.get(term, down)).otherwise(0.0)
            total = F.when(c == leaves, acc["sum"]).otherwise(acc["sum"] + changed)
            counts = [(acc[name] + F.when(kc == i, one(bc)).otherwise(F.lit(0)) - F.when((leaves >= 0) & (kl == i), one(bl)).otherwise(F.lit(0))).alias(name) for i, name in enumerate(longs)]
            least = F.when(acc["at"] + 1 >= window, F.least(acc["least"], total)).otherwise(acc["least"])
            return F.struct(*counts, total.alias("sum"), least.alias("least"), (acc["at"] + 1).alias("at"))

        return F.aggregate(all_chars, zero, step, lambda acc: F.greatest(F.lit(0.0), F.lit(log2(window)) - acc["least"] / window))

    return _let(chars, slide)


def _secret(m: Column, kind: str, window: int) -> Column:
    """Whether m isn't on the allow-list and has a window of high entropy for its class."""
    allowed = F.char_length(m) < window
    for p in ALLOWED:
        allowed = allowed | m.rlike(p)
    alphabet, least = CLASSES[kind]
    return F.when(allowed, False).otherwise(window_entropy(F.lower(m) if kind == "hex" else m, alphabet, window) >= least)


def _value(x: Column, window: int) -> Column:
    """The span without the names around it, where what stays is as long as a window; else as it is."""
    m = x["match"]
    lead = F.char_length(F.regexp_extract(m, LEAD, 0))
    core = lambda: F.substr(m, lead + 1, F.char_length(m) - lead - F.char_length(F.regexp_extract(F.reverse(F.substr(m, lead + 1)), TAIL_BACKWARDS, 0)))
    start = x["start"] + lead
    cut = lambda c: F.struct(start.alias("start"), x["kind"].alias("kind"), (start + F.char_length(c)).alias("end"), c.alias("match"))
    return _let(core(), lambda c: F.when(F.char_length(c) >= window, cut(c)).otherwise(x))


def entropy_spans(text: Column, window: int = WINDOW) -> Column:
    """The spans of the text (without those of the base kinds, which are blank in it) with a window of high entropy for their class, the
    allow-list's left out. Of each candidate, the runs of hex digits are judged by the limit of hex; then what is left, without the
    names around it, by that of base64."""
    kind = KINDS.index("entropy")

    def within(x):
        def judged(found):
            rest = F.transform(spans(blanked(found), CANDIDATE, kind), lambda y: _value(y, window))
            return F.concat(spans_of(found, kind), F.filter(rest, lambda y: _secret(y["match"], "base64", window)))

        return moved(_let(parts(x["match"], HEX_RUN, lambda m: _secret(m, "hex", window)), judged), x["start"])

    return F.flatten(F.transform(spans(text, CANDIDATE, kind), within))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: the id and `found`, an array of (start, kind, end), by start and kind.

    Base kinds are assign (a named value of at least 8 characters), access and hex; the entropy scan adds runs
    of each character class with a sliding window of high entropy that lie in no base span and aren't on the allow-list. Positions count
    code points, ends are exclusive. Null and empty texts have no spans; an empty table gives no rows; columns but the id and the text
    are not read. Row by row, with no shuffle: hot keys and copies make no difference, repeated rows get the same. Long texts
    take time in proportion to their length but for the lists of hits, which are put together in strides.
    """
    rows = docs.select(F.col(id_col).alias("_id"), or_empty(F.col(text_col)).alias("_text"))
    long_enough = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 8
    yes = lambda m: F.lit(True)
    rows = rows.withColumn("_base", F.concat(spans(F.col("_text"), ASSIGN, 0, long_enough), spans(F.col("_text"), ACCESS, 1), spans(F.col("_text"), HEX, 2)))
    left = F.col("_text")
    for pattern, hit in ((ASSIGN, long_enough), (ACCESS, yes), (HEX, yes)):
        rows = rows.withColumn("_text", F.when(left.rlike(pattern), blanked(parts(left, pattern, hit))).otherwise(left))
    found = F.array_sort(F.concat("_base", entropy_spans(F.col("_text"), window)))
    return rows.select(F.col("_id").alias(id_col), F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))).alias("found"))


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.filter("found", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), count(3).alias("n_entropy"),
    )
