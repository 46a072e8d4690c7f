"""Questions from formatted text runs (doc_id, paragraph, run_no, text, formats)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itemlake.functions import columns as C
from itemlake.plans.carry import in_order, last_known

PARAGRAPH = ["doc_id", "paragraph"]
# Line and marker patterns of the document format.
GOTHIC = ("ゴシック", "gothic")
NOISE = ("^\\s*[0-9]+\\s*$", "^[\\s　]*[<＜]\\s*以上", "学年.*番号.*氏名", "^[\\s　]*氏\\s*名[\\s　]*$")
QUESTION = "^[\\s　]*([0-9０-９]{1,3})[.．、]?[\\s　]+(?=\\S)"
CHOICE = "^[\\s　]*([ａ-ｅa-e])[.．、]?[\\s　]*"


def _formats() -> Column:
    """Formats in nesting order."""
    return F.array_intersect(F.array(*map(F.lit, C.FORMAT_TAGS)), F.coalesce("formats", F.array().cast("array<string>")))


def _format_bits() -> Column:
    """The formats of a run as bits: a number takes less of a shuffle, a sort and a comparison than an array of names."""
    bits = [F.when(F.array_contains("formats", tag), 1 << i).otherwise(0) for i, tag in enumerate(C.FORMAT_TAGS)]
    return reduce(Column.__add__, bits)


def merge_runs(runs: DataFrame) -> DataFrame:
    """doc_id, paragraph, island, text, formats: neighbouring runs with equal formats as one, empty runs dropped.

    Islands are numbered within a paragraph by a running count of format changes; a window holds one paragraph.
    """
    w = Window.partitionBy(*PARAGRAPH).orderBy("run_no")
    r = runs.filter(F.coalesce("text", F.lit("")) != "").select(*PARAGRAPH, "run_no", "text", _format_bits().alias("bits"))
    new = F.when((F.lag("bits").over(w) == F.col("bits")) & F.lag("run_no").over(w).isNotNull(), 0).otherwise(1)
    r = r.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_no", "text"))), lambda x: x["text"]), "")
    r = r.groupBy(*PARAGRAPH, "island").agg(text.alias("text"), F.first("bits").alias("bits"))
    formats = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(1 << i) != 0, tag) for i, tag in enumerate(C.FORMAT_TAGS)]))
    return r.select(*PARAGRAPH, "island", "text", formats.alias("formats"))


def paragraphs_of(runs: DataFrame) -> DataFrame:
    """doc_id, paragraph, text."""
    return runs.groupBy(*PARAGRAPH).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_no", "text"))), lambda x: x["text"]), "").alias("text"))


def is_noise(text: Column) -> Column:
    bad = C.trim_all(text) == ""
    for pattern in NOISE:
        bad = bad | text.rlike("(?U)" + pattern)
    return F.coalesce(bad, F.lit(True))


def drop_noise(paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): page numbers, name fields, end marks and blank lines go; skipped leaves out the blank ones."""
    noise = is_noise(F.col("text"))
    return paragraphs.filter(~noise), paragraphs.filter(noise & (C.trim_all(F.coalesce("text", F.lit(""))) != ""))


def segment_questions(paragraphs: DataFrame) -> DataFrame:
    """doc_id, paragraph, number, kind, label, text: stem, choice, continuation (of a stem) or stray, by leading markers.

    A question begins at a number and space; letters a to e begin a choice once a question has begun;
    other lines continue a stem until its first choice. The last number and the last marker are carried
    over range partitions by document and paragraph (see plans.carry), so a long document is many tasks.
    """
    number = C.narrow(F.regexp_extract("text", "(?U)" + QUESTION, 1))
    letter = F.lower(C.narrow(F.regexp_extract("text", "(?U)" + CHOICE, 1)))
    p = paragraphs.select(*PARAGRAPH, "text", F.when(number != "", number.cast("int")).alias("number"), F.when(letter != "", letter).alias("label"))
    p = last_known(in_order(p, PARAGRAPH), ["doc_id"], ["number"])
    mark = F.when(F.col("number").isNotNull(), "stem").when(F.col("label").isNotNull() & F.col("last_number").isNotNull(), "choice")
    p = last_known(p.withColumn("mark", mark), ["doc_id"], ["mark"])
    kind = F.when(F.col("mark").isNotNull(), F.col("mark")).when(F.col("last_mark") == "stem", "continuation").otherwise("stray")
    body = F.when(F.col("mark") == "stem", F.regexp_replace("text", "(?U)" + QUESTION, "")).when(F.col("mark") == "choice", F.regexp_replace("text", "(?U)" + CHOICE, "")).otherwise(F.col("text"))
    return p.select(*PARAGRAPH, F.col("last_number").alias("number"), kind.alias("kind"), F.when(F.col("mark") == "choice", F.col("label")).alias("label"), body.alias("text"))


def run_formats(runs: DataFrame) -> DataFrame:
    """runs with formats and unexpected, from the columns of a document's run properties that are there.

    bold, italic, superscript, subscript, underline, strike, all_caps (boolean), east_asia, ascii_name,
    color, highlight (string), size (points). A bold run or one in a gothic font is strong; what no tag
    stands for is unexpected, as name or name=value.
    """
    has = set(runs.columns)
    on = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in has else F.lit(False)
    value = lambda c: F.col(c).cast("string") if c in has else F.lit(None).cast("string")
    font = F.lower(C.narrow(F.coalesce(value("east_asia"), F.lit(""))))
    gothic = F.contains(font, F.lit(GOTHIC[0])) | F.contains(font, F.lit(GOTHIC[1]))
    tags = F.array(F.when(gothic | on("bold"), "strong"), F.when(on("italic"), "i"), F.when(on("superscript"), "sup"), F.when(on("subscript"), "sub"))
    size = F.regexp_replace(value("size"), r"\.0+$", "")
    odd = F.array(
        F.when(on("underline"), "underline"), F.when(on("strike"), "strike"), F.concat(F.lit("size="), size, F.lit("pt")), F.concat(F.lit("color="), value("color")),
        F.concat(F.lit("highlight="), value("highlight")), F.when(on("all_caps"), "all_caps"),
    )
    return runs.withColumn("formats", F.array_compact(tags)).withColumn("unexpected", F.array_compact(odd))


def _by_properties(runs: DataFrame) -> DataFrame:
    """The different properties of runs with n_runs: what is told of a run by them alone is made once for each."""
    known = ("bold", "italic", "superscript", "subscript", "underline", "strike", "all_caps", "east_asia", "ascii_name", "color", "highlight", "size")
    counts = runs.groupBy(*[c for c in known if c in set(runs.columns)]).agg(F.count(F.lit(1)).alias("n_runs"))
    return counts.filter("n_runs > 0")  # runs without any of these are one group, of none too


def count_formats(runs: DataFrame) -> DataFrame:
    """formats, unexpected, n_runs: how many runs have what run_formats tells of them."""
    return run_formats(_by_properties(runs)).groupBy("formats", "unexpected").agg(F.sum("n_runs").alias("n_runs"))


def font_census(runs: DataFrame) -> DataFrame:
    """entry, n_runs over runs with text: fonts of both scripts, and every property that is set, with values left out."""
    has = set(runs.columns)
    fonts = [F.concat(F.lit(f"{label}="), F.coalesce(F.col(c), F.lit("none"))) for label, c in (("eastAsia", "east_asia"), ("ascii", "ascii_name")) if c in has]
    flags = [F.when(F.col(c), name) for c, name in (("bold", "bold"), ("italic", "italic"), ("superscript", "sup"), ("subscript", "sub")) if c in has]
    known = run_formats(_by_properties(runs.filter(F.coalesce("text", F.lit("")) != "")))
    found = F.concat(F.array_compact(F.array(*fonts, *flags)), F.transform("unexpected", lambda u: F.substring_index(u, "=", 1)))
    return known.select(F.explode(found).alias("entry"), "n_runs").groupBy("entry").agg(F.sum("n_runs").alias("n_runs"))


def format_census(runs: DataFrame) -> DataFrame:
    """format, n_runs, n_chars: each format of a run counts, 'plain' where it has none."""
    f = _formats()
    one = runs.select(F.explode(F.when(F.size(f) > 0, f).otherwise(F.array(F.lit("plain")))).alias("format"), F.length("text").alias("n"))
    return one.groupBy("format").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n").alias("n_chars"))


def fragment_html(islands: DataFrame) -> DataFrame:
    """doc_id, paragraph, html: islands in order, each in its tags, with gapless equal tags joined."""
    opened = F.array_join(F.transform("formats", lambda t: F.concat(F.lit("<"), t, F.lit(">"))), "")
    closed = F.array_join(F.transform(F.reverse("formats"), lambda t: F.concat(F.lit("</"), t, F.lit(">"))), "")
    one = F.concat(opened, C.escape_text(F.col("text")), closed)
    joined = islands.withColumn("one", one).groupBy(*PARAGRAPH).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("island", "one"))), lambda x: x["one"]), "").alias("html"))
    return joined.select(*PARAGRAPH, C.collapse_tags(F.col("html")).alias("html"))
