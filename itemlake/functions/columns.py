"""Column functions on item texts, patterns, keys and flags. All but nfkc stay in the JVM."""

from __future__ import annotations

import html
import json
import unicodedata
from collections.abc import Sequence
from html import entities
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = "abcde"
BLANK, OTHER = "", "?"
ITEM_TYPES = ("A", "X2", "X3", "X4", "XX")
# Texts and thresholds of the item format.
INSTRUCTIONS = {"A": "1つ選べ。", "X2": "2つ選べ。", "X3": "3つ選べ。", "X4": "4つ選べ。", "XX": "すべて選べ。"}
NEGATIVE_WORDS = ("ない", "でない", "含まれない", "誤っている")
FORMAT_TAGS = ("strong", "i", "sup", "sub")
# Fixed value: the characters between which a space is dropped.
JAPANESE = "[\\u3040-\\u30ff\\u4e00-\\u9fff\\u3005\\u8c48-\\ufaff]"
PATTERNS = tuple("".join(c) for n in range(1, 6) for c in combinations(LABELS, n))


def all_patterns(spark: SparkSession) -> DataFrame:
    """(pattern, ord, size): the 31 answer patterns, by size and then letters."""
    return spark.createDataFrame([(p, i, len(p)) for i, p in enumerate(PATTERNS)], "pattern string, ord int, size int")


def pattern_order(pattern: Column) -> Column:
    """Place of a pattern in column order: by size, then letters; null for blank and other."""
    return F.when(pattern.rlike("^a?b?c?d?e?$") & (pattern != ""), F.array_position(F.array(*map(F.lit, PATTERNS)), pattern).cast("int") - 1)


# --- markup -----------------------------------------------------------------------------------


def _reference(piece: Column) -> Column:
    """A text that begins with & with the character reference there, if it is one, decoded."""
    number = F.coalesce(
        F.regexp_extract(piece, "^&#([0-9]{1,9})", 1).try_cast("long"), F.conv(F.nullif(F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]{1,8})", 1), F.lit("")), 16, 10).cast("long"),
    )
    high = F.try_element_at(F.array(*[F.lit(html.unescape(f"&#{n};")) for n in range(0x80, 0xA0)]), (number - 0x7F).cast("int"))
    char = (
        F.when((number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), "\ufffd").when(number.between(0x80, 0x9F), high)
        .when(number.between(1, 8) | number.between(14, 31) | (number == 11) | (number == 127), "").otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    )
    full = F.regexp_extract(piece, "^&([A-Za-z][A-Za-z0-9]*;)", 1)
    short = F.regexp_extract(piece, f"^&({'|'.join(sorted((n for n in entities.html5 if not n.endswith(';')), key=len, reverse=True))})", 1)
    names = F.from_json(F.lit(json.dumps(entities.html5)), "map<string,string>")
    told = F.transform(F.array(full, short), lambda name: F.concat(F.try_element_at(names, name), F.substr(piece, F.length(name) + 2)))
    decoded = F.concat(char, F.regexp_replace(piece, "^&#([0-9]+|[xX][0-9a-fA-F]+);?", ""))
    return F.when(number.isNotNull(), decoded).otherwise(F.coalesce(F.get(F.array_compact(told), F.lit(0)), piece))


# Fixed value: the references that most texts have, and what they stand for; the ampersand's is decoded last, so nothing is decoded twice.
COMMON = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}


def strip_tags(html_text: Column) -> Column:
    """Text without tags and comments, with all character references decoded once: numbers, HTML's names, and those of them that need no semicolon."""
    s = F.regexp_replace(html_text, "(?s)<!--.*?-->|<[A-Za-z/!?][^>]*>", "")
    common = s
    for reference, char in COMMON.items():
        common = F.replace(common, F.lit(reference), F.lit(char))
    pieces = F.transform(F.split(s, "(?=&)"), lambda p: F.when(F.startswith(p, F.lit("&")), _reference(p)).otherwise(p))
    others = s.rlike(f"&(?!(?:{'|'.join(c[1:] for c in COMMON)}))")
    return F.when(~F.contains(s, F.lit("&")), s).when(~others, common).otherwise(F.array_join(pieces, ""))


def has_tag(html: Column, tag: str) -> Column:
    if tag.lower() not in FORMAT_TAGS:
        raise ValueError(f"not a format tag: {tag}")
    return html.rlike(f"(?i)<{tag.lower()}\\s*>")


def escape_text(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def collapse_tags(html: Column, tags: Sequence[str] = FORMAT_TAGS) -> Column:
    """Without empty elements and gapless adjacent equal ones; nesting is at most as deep as there are tags."""
    names = "|".join(tags)
    for _ in tags:
        html = F.regexp_replace(html, f"<({names})></\\1>|</({names})><\\2>", "")
    return html


def clean_markup(html: Column, tags: Sequence[str] = FORMAT_TAGS) -> Column:
    """Only the listed tags, lower-case and without attributes; comments, declarations and all other tags go, texts stay."""
    names = "|".join(tags)
    s = F.regexp_replace(html, "(?s)<!--.*?-->|<[!?][^>]*>", "")
    s = F.regexp_replace(s, f"(?i)<(?!/?(?:{names})(?:\\s[^>]*)?/?>)/?[A-Za-z][^>]*>", "")
    for tag in tags:
        s = F.regexp_replace(s, f"(?i)<{tag}(?:\\s[^>]*)?/?>", f"<{tag}>")
        s = F.regexp_replace(s, f"(?i)</{tag}\\s*>", f"</{tag}>")
    return collapse_tags(s, tags)


def removed_tags(html: Column, tags: Sequence[str] = FORMAT_TAGS) -> Column:
    """Array of the lower-case names of opening tags that clean_markup takes out; a comment counts as '!--'."""
    found = F.regexp_extract_all(F.regexp_replace(html, "(?s)<!--.*?-->", "<!-->"), F.lit("<(!--|[A-Za-z][A-Za-z0-9]*)[^>]*>"), F.lit(1))
    return F.filter(F.transform(found, F.lower), lambda t: ~t.isin(*tags))


def markup_census(df: DataFrame, html: str, tags: Sequence[str] = FORMAT_TAGS) -> DataFrame:
    """(tag, removals) over all rows."""
    return df.select(F.explode(removed_tags(F.col(html), tags)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("removals"))


#: Bytes of text that are Python objects at once.
_NFKC_SLICE = 1 << 20


def _nfkc(text: pa.Array) -> pa.Array:
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    parts, at = [], 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + _NFKC_SLICE, "right")) - 1)
        parts.append(pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in text.slice(at, to - at).to_pylist()], text.type))
        at = to
    return pa.concat_arrays(parts) if parts else text


def nfkc(text: Column) -> Column:
    """NFKC for any text. No Spark function has it, so this one column runs in Arrow batches, of which a megabyte at once becomes Python strings."""

    def normal(t: pa.Array) -> pa.Array:
        return _nfkc(t)

    return F.arrow_udf(normal, "string")(text)


def narrow(text: Column) -> Column:
    """The part of NFKC that keys and instructions need: full-width ASCII and the ideographic space."""
    return F.translate(text, "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　", "".join(chr(c) for c in range(0x21, 0x7F)) + " ")


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def normalize_stem(html: Column, exact: bool = False) -> Column:
    """Clean markup, NFKC (all of it if exact), trimmed."""
    return trim_all(clean_markup(nfkc(html) if exact else narrow_text(html)))


def narrow_text(html: Column) -> Column:
    """narrow() that leaves full-width < > & alone, which would turn into markup."""
    return F.translate(html, "".join(chr(c) for c in range(0xFF01, 0xFF5F) if chr(c - 0xFEE0) not in "<>&") + "　", "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) not in "<>&") + " ")


def normalize_choice(html: Column, exact: bool = False) -> Column:
    """normalize_stem, and two Japanese characters lose the space between them."""
    return F.regexp_replace(normalize_stem(html, exact), f"(?U)^({JAPANESE})[\\u3000\\s]({JAPANESE})$", "$1$2")


def is_spaced_pair(html: Column) -> Column:
    return html.rlike(f"(?U)^{JAPANESE}[\\u3000\\s]{JAPANESE}$")


def render_choice(text: Column, override: Column | None = None) -> Column:
    spaced = F.regexp_replace(text, f"^({JAPANESE})({JAPANESE})$", "$1　$2")
    return spaced if override is None else F.coalesce(override, spaced)


# --- item types and keys ----------------------------------------------------------------------

_ALL = "(?:すべて|全て)(?:を)?選べ"
_SOME = "([1-9一二三四五])\\s*つ(?:を)?選べ"
# Fixed value: the wording of an instruction.
_RAW = f"(?:{_ALL}|[1-9１-９一二三四五][　\\s]*つ(?:を)?選べ)[。.]?"


def _instruction(stem: Column) -> tuple[Column, Column, Column]:
    plain = narrow(strip_tags(stem))
    number = F.translate(F.regexp_extract(plain, _SOME, 1), "一二三四五", "12345")
    return plain, plain.rlike(_ALL), F.when(number != "", number.cast("int"))


def _by_asked(stem: Column, every: str | None, by_number: dict[str, str]) -> Column:
    """every where all are to be chosen, else what by_number has for the number asked ('' for none): one lookup, so that the stripped stem is in the plan twice."""
    plain = narrow(strip_tags(stem))
    number = F.translate(F.regexp_extract(plain, _SOME, 1), "一二三四五", "12345")
    return F.when(plain.rlike(_ALL), F.lit(every)).otherwise(F.try_element_at(F.create_map(*[F.lit(x) for kv in by_number.items() for x in kv]), F.coalesce(number, F.lit(""))))


def item_type(stem: Column) -> Column:
    """A, X2, X3, X4 or XX from the instruction in the stem; null if there is none or it asks for five or more."""
    return _by_asked(stem, "XX", {"1": "A", "2": "X2", "3": "X3", "4": "X4"})


def type_problem(stem: Column) -> Column:
    """Why item_type is null: five_of_five, over_five or no_instruction."""
    return _by_asked(stem, None, {"": "no_instruction", "5": "five_of_five"} | {str(n): "over_five" for n in range(6, 10)})


def instruction_of(stem: Column) -> Column:
    plain, every, n = _instruction(stem)
    return F.when(every, F.regexp_extract(plain, _ALL, 0)).when(n.isNotNull(), F.regexp_extract(plain, _SOME, 0))


def set_instruction(stem: Column, kind: Column) -> Column:
    """The last instruction in the stem becomes that of the type; without one it is added. An unknown type gives null."""
    wanted = F.create_map(*[F.lit(x) for pair in INSTRUCTIONS.items() for x in pair])[kind]
    head = F.regexp_extract(stem, f"(?s)^(.*){_RAW}", 1)
    tail = F.regexp_extract(stem, f"(?s)^.*{_RAW}(.*)$", 1)
    return F.when(stem.rlike(_RAW), F.concat(head, wanted, tail)).otherwise(F.concat(stem, wanted))


def normalize_correct(correct: Column) -> Column:
    """The letters a-e in it, sorted, each once."""
    letters = F.filter(F.split(F.lower(narrow(correct)), ""), lambda c: c.isin(*LABELS))
    return F.array_join(F.array_sort(F.array_distinct(letters)), "")


def is_negative(stem: Column) -> Column:
    return has_tag(stem, "strong")


def contains_any(html: Column, words: Sequence[str] = NEGATIVE_WORDS) -> Column:
    """Does the stripped text contain any of the words?"""
    plain = strip_tags(html)
    return F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(plain, w)), F.lit(False)) if words else F.lit(False)


def required_count(kind: Column) -> Column:
    return F.when(kind == "A", 1).when(kind.isin("X2", "X3", "X4"), F.try_to_number(F.substring(kind, 2, 1), F.lit("9")).cast("int"))


def type_rank(kind: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, ITEM_TYPES)), kind).cast("int") - 1, F.lit(9))


# --- choice orders and sets -------------------------------------------------------------------


def is_choice_order(order: Column) -> Column:
    return F.coalesce(F.array_join(F.array_sort(F.split(order, "")), "") == "12345", F.lit(False))


def label_to_item_no(label: Column, order: Column) -> Column:
    at = F.instr(F.lit(LABELS), label)
    return F.when(at > 0, F.substring(order, at, F.lit(1)).cast("int"))


def item_no_to_label(item_no: Column, order: Column) -> Column:
    at = F.instr(order, item_no.cast("string"))
    return F.when(at > 0, F.substring(F.lit(LABELS), at, F.lit(1)))


def correct_to_item_nos(correct: Column, order: Column) -> Column:
    """Sorted array of the stable item numbers of a key given in printed letters."""
    letters = F.filter(F.split(correct, ""), lambda c: c != "")
    return F.array_sort(F.transform(letters, lambda c: F.substring(order, F.instr(F.lit(LABELS), c), F.lit(1)).cast("int")))


def item_nos_to_correct(nos: Column, order: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(nos, lambda n: F.substring(F.lit(LABELS), F.instr(order, n.cast("string")), F.lit(1)))), "")


def choice_signature(items: Column) -> Column:
    """SHA-256 of the sorted items joined by U+001F."""
    return F.sha2(F.array_join(F.array_sort(items), "\u001f").cast("binary"), 256)


def set_similarity(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def relation_for(shared: Column) -> Column:
    return F.when(shared >= 5, "identical").when(shared >= 3, "near").when(shared == 2, "candidate")


def should_autolink(shared: Column, min_shared: int = 3) -> Column:
    return (shared >= min_shared) & (shared <= 4)


# --- numbers, flags, labels -------------------------------------------------------------------


def disc_resolution(n: Column, fraction: float = 0.25) -> Column:
    """The step of a discrimination index, 1 / floor(n * fraction); null where the group is empty."""
    return F.try_divide(F.lit(1.0), F.floor(n * fraction).cast("double"))


def is_disc_on_grid(disc: Column, n: Column, fraction: float = 0.25, tolerance: float = 1e-3) -> Column:
    step = disc_resolution(n, fraction)
    return F.coalesce(F.abs(disc - F.rint(F.try_divide(disc, step)) * step) <= tolerance, F.lit(False))


def encode_flags(flags: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(flags)), ",")


def decode_flags(flags: Column) -> Column:
    return F.filter(F.split(F.coalesce(flags, F.lit("")), ","), lambda f: f != "")


def exam_year(date: Column) -> Column:
    return F.substring(date, 1, 4).try_cast("int")


def _percent(p: Column) -> Column:
    return F.concat(F.bround(p * 100, 0).cast("int").cast("string"), F.lit("%"))


def _bracket(kind: Column) -> Column:
    return F.concat(F.lit("("), F.coalesce(kind, F.lit("?")), F.lit(")"))


def p_label(p: Column, kind: Column) -> Column:
    """A rate is always shown with its type: 52%(X2); a missing one as a dash."""
    return F.concat(F.coalesce(_percent(p), F.lit("—")), _bracket(kind))


def candidate_label(p: Column, kind: Column, disc: Column, negative: Column) -> Column:
    rate = F.coalesce(F.concat(F.lit("正答率"), _percent(p)), F.lit("新作"))
    index = F.coalesce(F.concat(F.lit(" D="), F.format_string("%.3f", disc)), F.lit(""))
    return F.concat(rate, _bracket(kind), F.when(disc.isNull(), "").otherwise(index), F.when(negative, " 否定形").otherwise(""))


def verdict(median_rate: Column, n: Column, dead: float = 0.05, strong: float = 0.25) -> Column:
    """A term as a distractor: none, dead, strong or normal."""
    return F.when((n == 0) | median_rate.isNull(), "none").when(median_rate < dead, "dead").when(median_rate >= strong, "strong").otherwise("normal")
