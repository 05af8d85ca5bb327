"""Text rules and small scalar functions, as Column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


# The characters that count as white space in Unicode, and those that end a line.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x85\x{2028}\x{2029}]"


def strip(c: Column) -> Column:
    """Without white space of any script at both ends. In linear time, which a pattern for the end would not take."""
    return F.trim(c, F.lit(SPACES))


def lines(c: Column) -> Column:
    return F.split(c, LINE_END)


def normalize(c: Column) -> Column:
    """Lower case, words only, one pass of article removal, single spaces. The patterns are fixed values."""
    c = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " ")
    c = strip(F.regexp_replace(c, r"\s+", " "))
    c = F.regexp_replace(c, r"(^|\s)(a|an|the)(\s|$)", " ")
    return strip(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(normalize(c), " "), lambda x: x != "")


def keywords(c: Column) -> Column:
    """Comma list: trimmed, not empty, distinct."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), strip), lambda x: x != ""))


def clean_line(c: Column) -> Column:
    """Leading dashes and spaces go as a set; null for lines without content."""
    line = strip(F.ltrim(strip(c), F.lit("- ")))
    return F.when((line != "") & (F.lower(line) != "none") & ~line.startswith("【"), line)


def fact_line(c: Column) -> Column:
    line = strip(F.regexp_replace(strip(c), "^- ", ""))
    return F.when((F.length(line) > 10) & (F.lower(line) != "none"), line)


def judged(c: Column) -> Column:
    """Yes or no of a judge's reply: by the first word of its first line without punctuation, else by a yes anywhere in that line."""
    line = strip(F.split(strip(F.lower(F.coalesce(c, F.lit("")))), LINE_END)[0])
    head = F.split(strip(F.regexp_replace(line, r"[.!:;]", "")), f"{SPACE}+")[0]
    return head.isin("yes", "y") | ((head != "") & ~head.isin("no", "n") & line.contains("yes"))


def parsed_time(c: Column) -> Column:
    """The three accepted forms, the first that matches."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("h:mm a 'on' d MMMM, yyyy")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("d MMMM yyyy")))


def time_decay(ts: Column, as_of: Column, tau: float) -> Column:
    age = F.unix_timestamp(as_of) - F.unix_timestamp(F.try_to_timestamp(ts, F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.coalesce(F.exp(-age / F.lit(tau)), F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Of length 1, a zero vector unchanged."""
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: (x / n).cast("float")))


def direction(v: Column) -> Column:
    """In doubles and divided by its norm, which counts as 1e-10 at least; made once per row, before vectors meet in pairs."""
    n = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-10))
    return F.transform(v, lambda x: x.cast("double") / n)


def common_tokens(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token lists, by one walk over both, sorted together."""
    tagged = F.array_sort(F.concat(F.transform(a, lambda w: F.struct(w.alias("w"), F.lit(1).alias("l"))), F.transform(b, lambda w: F.struct(w.alias("w"), F.lit(0).alias("l")))))
    start = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("left"), F.lit(0).alias("n"))

    def step(s, x):  # of equal tokens those of b come first and wait for those of a
        waiting = F.when(s["w"].eqNullSafe(x["w"]), s["left"]).otherwise(0)
        met = (x["l"] == 1) & (waiting > 0)
        return F.struct(x["w"].alias("w"), F.when(x["l"] == 0, waiting + 1).when(met, waiting - 1).otherwise(waiting).alias("left"), (s["n"] + met.cast("int")).alias("n"))

    return F.aggregate(tagged, start, step, lambda s: s["n"])


def frequent(words: Column, most: int) -> Column:
    """The most frequent of the words, ties in alphabetical order, by one walk over the sorted list."""
    runs = F.array_sort(F.transform(words, lambda w: F.struct(w.alias("w"))))
    top = "array<struct<n: int, w: string>>"
    start = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("n"), F.lit(None).cast(top).alias("top"))

    def best(s):
        run = F.array(F.struct((-s["n"]).alias("n"), s["w"].alias("w")))
        return F.when(s["n"] == 0, s["top"]).otherwise(F.slice(F.array_sort(F.concat(F.coalesce(s["top"], F.array().cast(top)), run)), 1, most)).cast(top)

    def step(s, x):
        same = s["w"].eqNullSafe(x["w"])
        return F.struct(x["w"].alias("w"), F.when(same, s["n"] + 1).otherwise(1).alias("n"), F.when(same, s["top"]).otherwise(best(s)).cast(top).alias("top"))

    return F.transform(F.coalesce(F.aggregate(runs, start, step, best), F.array().cast(top)), lambda t: t["w"])


def name_key(path: Column) -> Column:
    """A file's name up to its first underscore, by which profiles are looked up beside stored graphs."""
    return F.split_part(F.element_at(F.split(path, "/"), -1), F.lit("_"), F.lit(1))


def new_id(prefix: str = "") -> Column:
    """A random identifier of eight hexadecimal digits behind a prefix."""
    return F.concat(F.lit(prefix), F.substring(F.expr("uuid()"), 1, 8))


def sample_key(*parts: Column) -> Column:
    """An identifier of a sample without one, the same in every run."""
    return F.concat(F.lit("sample_"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 12))


def reference_answer(answer: Column, adversarial: Column) -> Column:
    """The answer, or the adversarial one where it is null or empty; 0 and false are answers."""
    return F.coalesce(F.nullif(answer.cast("string"), F.lit("")), adversarial.cast("string"))


# Question categories by number.
CATEGORIES = {1: "Multi-hop", 2: "Temporal", 3: "Open-domain", 4: "Single-hop", 5: "Adversarial"}


def category_number(c: Column) -> Column:
    """Of numbers and of texts that hold one; 0 for others."""
    return F.coalesce(strip(c.cast("string")).try_cast("int"), F.lit(0))


def category_name(c: Column) -> Column:
    names = F.array(F.lit(None).cast("string"), *map(F.lit, CATEGORIES.values()))
    n = category_number(c)
    return F.coalesce(F.when(n >= 0, F.get(names, n)), F.lit("Unknown"))


def keyword_score(q: Column, n: Column) -> Column:
    return F.when((F.size(q) > 0) & (F.size(n) > 0), F.size(F.array_intersect(q, n)) / F.size(q)).otherwise(F.lit(0.0))


def abstains(question_id: Column) -> Column:
    """Whether a question can't be answered, as its identifier tells."""
    return question_id.contains("abs")


def two_decimals(c: Column) -> Column:
    """A number with two decimals, a half going to the even one, without marks between thousands."""
    return F.replace(F.format_number(c, 2), F.lit(","), F.lit(""))
