"""Rules that read entries out of a document's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .texts import lines_with_offsets

#: A dated header: title, dash, employer, comma, place, and the dates in brackets.
HEADER = r"^\s*(.{2,90}?) [—–-] (.{2,90}?)(?:, ([^,(]{1,40}))? \(([^()]{2,20}?) [–-] ?([^()]{0,20})\)\s*$"
BULLET = r"^\s*[•*–▪-]\s+"
#: On lower-cased lines; the edges of words are spelt out, as engines differ on `\b` beside accented letters.
DEGREE = r"(?:^|[^\p{L}])(phd|mba|msc|bsc|ba|máster|grado|licence|licenciatura|doctorat|doctorado|doutoramento|promotion|master|bachelor|dottorato|laurea|mestrado)(?:[^\p{L}]|$)"
INSTITUTION = r"(?:^|[^\p{L}])(universit(?:y|é|ät|à)|universidade?|college|institute|school)(?:[^\p{L}]|$)"


def role_entries(df: DataFrame, key: str, text: str, most_highlights: int = 5) -> DataFrame:
    """(`key`, `entry`, `title`, `employer`, `location`, `start`, `end`, `highlights`): one row a dated header,
    with the lines of more than 45 characters below it, the first `most_highlights`.

    Lines belong to the header above them: the running count of headers numbers them. Texts are
    independent; NULL and empty ones have no entries.
    """
    lines = lines_with_offsets(df, key, text).withColumn("line", F.regexp_replace("line", "\r$", ""))
    head = F.regexp_like("line", F.lit(HEADER)) & ~F.regexp_like("line", F.lit(BULLET))
    w = Window.partitionBy(key).orderBy("line_no")
    placed = lines.withColumn("head", head).withColumn("entry", F.sum(F.col("head").cast("int")).over(w))
    part = lambda n: F.nullif(F.trim(F.regexp_extract("line", HEADER, n)), F.lit(""))
    heads = placed.where("head").select(key, "entry", part(1).alias("title"), part(2).alias("employer"), part(3).alias("location"), part(4).alias("start"), part(5).alias("end"))
    below = placed.where("not head and entry > 0 and length(trim(line)) > 45")
    rank = F.row_number().over(Window.partitionBy(key, "entry").orderBy("line_no"))
    kept = below.withColumn("r", rank).where(F.col("r") <= most_highlights)
    listed = kept.groupBy(key, "entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.trim(F.regexp_replace("line", BULLET, "")).alias("t")))), lambda x: x["t"]).alias("highlights"))
    return heads.join(listed, [key, "entry"], "left").withColumn("highlights", F.coalesce("highlights", F.array().cast("array<string>")))


#: A month or year as it is written in headers, and a range of two or up to now.
MOMENT = r"(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]{0,6}[ .\-']*(?:[0-9]{4}|[0-9]{2})|(?:0?[1-9]|1[0-2])/(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])|(?:19|20)[0-9]{2})"
DATED = rf"(?i)\b({MOMENT})\s*(?:-|–|—|to)\s*({MOMENT}|present|current|till date|now)\b"
#: What parts title, employer and place on a line, and what may stand around them.
PARTED = r"\s+[–—|]\s+|\s{2,}|\t+|,\s+"
AROUND = " ,|()–—-\t\r"


def dated_entries(df: DataFrame, key: str, text: str, title_words: str, org_words: str) -> DataFrame:
    """(`key`, `entry`, `line_no`, `title`, `employer`, `start`, `end`): one row a dated line that is no bullet, whatever its form.

    Title and employer are the parts of the line beside its dates, told apart by words of titles and of firms;
    where it has none, of the line above (blank lines and bullets passed over, three lines at most); where only
    one is there, the other may be the line above or below. Texts are independent; NULL and empty ones have no rows.
    """
    like = lambda c, p: F.coalesce(F.regexp_like(c, F.lit(p)), F.lit(False))
    lines = lines_with_offsets(df, key, text).select(F.col(key), "line_no", F.trim("line", F.lit(" \t\r")).alias("s"), F.regexp_like("line", F.lit(BULLET)).alias("bullet"))
    dated = ~F.col("bullet") & (F.length("s") <= 160) & F.regexp_like("s", F.lit(DATED))
    lines = lines.withColumn("dated", dated)
    plain = F.when((F.col("s") == "") | F.col("bullet"), None).when(F.col("dated") | (F.length("s") > 90), "").otherwise(F.col("s"))
    w = Window.partitionBy(key).orderBy("line_no")
    near = lines.withColumn("c", plain)
    around = near.withColumns({"above": F.nullif(F.coalesce(*[F.lag("c", i).over(w) for i in (1, 2, 3)]), F.lit("")), "below": F.nullif(F.lead("c", 1).over(w), F.lit(""))})
    heads = around.where("dated").withColumn("rest", F.trim(F.regexp_replace("s", DATED, ""), F.lit(AROUND)))
    used = F.when(F.col("rest") != "", F.col("rest")).otherwise(F.col("above"))
    heads = heads.withColumn("parts", F.filter(F.transform(F.split(F.coalesce(used, F.lit("")), PARTED), lambda x: F.trim(x, F.lit(AROUND))), lambda x: x != ""))
    one, two = F.get("parts", F.lit(0)), F.get("parts", F.lit(1))
    titled, firm = lambda c: like(c, title_words), lambda c: like(c, org_words)
    turned = (firm(one) & ~titled(one)) | (titled(two) & ~titled(one))
    lone_title = titled(one) & ~firm(one)
    title = F.when(two.isNull(), F.when(lone_title, one).when(titled(F.col("below")), F.col("below"))).when(turned & ~titled(two) & titled(F.col("below")), F.col("below")).when(turned, two).otherwise(one)
    employer = F.when(two.isNull(), F.when(~lone_title, one).when(F.col("rest") != "", F.col("above"))).when(turned, one).otherwise(two)
    return heads.select(
        key, F.row_number().over(w).alias("entry"), "line_no", title.alias("title"), employer.alias("employer"),
        F.regexp_extract("s", DATED, 1).alias("start"), F.regexp_extract("s", DATED, 2).alias("end"),
    )


def education_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(`key`, `line_no`, `degree`, `institution`, `year`): lines that name both or either, with the last year on the line."""
    lines = lines_with_offsets(df, key, text)
    years = F.regexp_extract_all("line", F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1))
    degree, place = F.nullif(F.regexp_extract(F.lower("line"), DEGREE, 1), F.lit("")), F.nullif(F.regexp_extract(F.lower("line"), INSTITUTION, 1), F.lit(""))
    rows = lines.where(~F.regexp_like("line", F.lit(BULLET)) & (F.length("line") <= 120))
    return rows.select(key, "line_no", degree.alias("degree"), place.alias("institution"), F.try_element_at(years, F.lit(-1)).cast("int").alias("year")).where("degree is not null and institution is not null")


def near_hits(df: DataFrame, key: str, text: str, word: str, context: str, reach: int) -> Column:
    """Number of places of `word` (a pattern) with `context` within `reach` characters on either side."""
    pattern = rf"(?is)(?:(?:{context}).{{0,{reach}}}(?<![\w+#]){word}(?![\w+#]))|(?:(?<![\w+#]){word}(?![\w+#])(?=.{{0,{reach}}}(?:{context})))"
    return F.regexp_count(text, F.lit(pattern))


def prefer_first(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """The union of two tables by `key`: `value` of the first where it has one, else of the second, and where it came from."""
    left, right = a.groupBy(*key).agg(F.max(value).alias("va")), b.groupBy(*key).agg(F.max(value).alias("vb"))
    both = left.withColumn("ia", F.lit(True)).join(right.withColumn("ib", F.lit(True)), key, "full")
    source = F.when(F.col("ia") & F.col("ib"), "both").when(F.col("ia"), "first").otherwise("second")
    return both.select(*key, F.coalesce("va", "vb").alias(value), source.alias("source"))


def closest(values: DataFrame, value: str, asked: list[str], cutoff: float) -> DataFrame:
    """(`asked`, `value`, `likeness`): the likest distinct value of each question by edit distance, above `cutoff`; ties by value.

    The questions are a few words of the caller, spread over the distinct values as rows.
    """
    pairs = values.select(value).where(F.col(value).isNotNull()).distinct().select(value, F.explode(F.array(*map(F.lit, asked))).alias("asked"))
    size = F.greatest(F.length("asked"), F.length(value), F.lit(1))
    like = pairs.withColumn("likeness", F.round(1 - F.levenshtein(F.lower("asked"), F.lower(value)) / size, 4)).where(F.col("likeness") >= cutoff)
    return like.groupBy("asked").agg(F.min_by(F.struct(value, "likeness"), F.struct(-F.col("likeness"), value)).alias("b")).select("asked", f"b.{value}", "b.likeness")


def overlay(base: DataFrame, corrections: DataFrame, key: str, columns: list[str], at: str) -> DataFrame:
    """`base` with the last correction of each column of each key laid over it; a NULL correction corrects nothing."""
    last = corrections.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(f"__{c}") for c in columns])
    joined = base.join(last, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])
