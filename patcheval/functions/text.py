"""Column -> Column text functions. All run in the JVM; none is a UDF.

Regex flags used throughout: ``d`` (only ``\\n`` ends a line), ``U`` (Unicode classes),
``m`` where ``^``/``$`` must match at inner lines.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from patcheval import constants as C

# every character str.strip() of the usual scripting languages treats as blank
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
# the same characters as a class, and without the line end
WS = r"[\s\x1c-\x1f]"
INLINE_WS = r"[^\S\n]"
NOT_WS = r"\S"
BLANK_RUN = "(?U)" + WS + "+"

# A mark put in front of a section so that split() can cut a text there. The first of its characters
# is escaped in the text, so the text itself never holds the mark.
CUT = "\x01\x02"
_ESCAPED = "\x01\x03"
#: A second mark of the same kind, between the parts of what CUT is put in front of.
PART = "\x01\x04"


def strip(col: Column) -> Column:
    """Remove blanks of any kind at both ends."""
    return F.btrim(col, F.lit(BLANKS))


def lines_of(col: Column) -> Column:
    return F.split(col, "\n", -1)


def escaped(col: Column) -> Column:
    """A text into which CUT may be put: ``cut`` takes it apart there and gives the pieces as they were."""
    return F.replace(col, F.lit("\x01"), F.lit(_ESCAPED))


def unescaped(piece: Column) -> Column:
    return F.replace(piece, F.lit(_ESCAPED), F.lit("\x01"))


def cut(marked: Column) -> Column:
    """The pieces of a marked text. They are read off it twice, so below an explode it should be a column of its own."""
    pieces = F.split(marked, CUT, -1)
    back = F.transform(pieces, unescaped)
    return F.when(F.contains(marked, F.lit(_ESCAPED)), back).otherwise(pieces)


def cut_before(col: Column, line_pattern: str) -> Column:
    """Array of sections of a text; each section but the first starts where ``line_pattern``
    (a pattern for the start of a line) matches. Linear in the text, no nested repetition."""
    return cut(marked_before(col, line_pattern))


def marked_before(col: Column, line_pattern: str) -> Column:
    """The text that ``cut`` takes apart to what ``cut_before`` gives."""
    return F.regexp_replace(escaped(col), f"(?mdU)^(?={line_pattern})", CUT)


def cut_at_outdent(col: Column) -> Column:
    """Array of sections of a text, cut before each unindented line that follows a non-blank
    line: an unindented head with everything that hangs below it."""
    return cut(F.regexp_replace(escaped(col), r"(?dU)(\S[^\S\n]*+\n)(?=\S)", "$1" + CUT))


_STRICT = {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}


def _only(text: Column, listed: Column, inner: Column, early: Column) -> Column:
    """The element of ``listed``, if it is the only one and its list was not closed ``early``, or ``inner`` shows that it was not."""
    # an array of one list, so that the text is read once
    held = F.transform(F.array(listed), lambda x: F.when((F.size(x) == 1) & (~early | inner["_bad"].isNull()), F.get(x, F.lit(0))))
    return F.get(held, F.lit(0))


def json_fields(text: Column, fields: str) -> Column:
    """struct of ``fields`` of a text that is one JSON object and nothing else; null of any other text.

    A JSON reader stops behind the first value. What follows it shows up when the text is read as the only element of a
    list, unless it closes the list; a text in which that may be is also read as the only field of an object.
    """
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{fields}>>", _STRICT)
    inner = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), f"v struct<{fields}>, _bad string", _STRICT)
    return _only(text, listed, inner, text.rlike(r"\}\s*+\]"))


def json_value(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else; null of any other text."""
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<variant>", _STRICT)
    inner = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v variant, _bad string", _STRICT)
    return _only(text, listed, inner, F.contains(text, F.lit("]")))


def after_first_line(col: Column) -> Column:
    """Text below the first newline, or ''."""
    at = F.instr(col, "\n")
    return F.when(at > 0, F.substring(col, at + 1, F.length(col))).otherwise(F.lit(""))


def tail_from(col: Column, start: Column) -> Column:
    """Elements of an array from the zero-based index ``start``."""
    return F.slice(col, start + 1, F.greatest(F.size(col) - start, F.lit(0)))


def first_index(array: Column, predicate) -> Column:
    """Zero-based index of the first element for which predicate(element, index) holds; else null."""
    hits = F.transform(array, lambda x, i: F.when(predicate(x, i), i))
    return F.array_min(F.filter(hits, lambda h: h.isNotNull()))


def normalize_test_name(name: Column) -> Column:
    """strip, lower, drop one leading 'test ', drop quotes, collapse blanks: in that order."""
    x = F.lower(strip(name))
    x = F.regexp_replace(x, r"\Atest ", "")
    x = F.translate(x, "\"'", "")
    return strip(F.regexp_replace(x, BLANK_RUN, " "))


def words_of(normalized: Column) -> Column:
    """Distinct words of a normalised name ('' has none)."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda w: w != ""))


def parse_duration(text: Column) -> Column:
    """Number in a duration; the unit is not looked at, anything unreadable counts 0."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def parse_duration_with_unit(value: Column, unit: Column) -> Column:
    """Milliseconds from a number and one of ms, s, m."""
    number = value.try_cast("double")
    factor = F.when(F.lower(unit) == "s", 1000.0).when(F.lower(unit) == "m", 60000.0).otherwise(1.0)
    return F.coalesce(number * factor, F.lit(0.0))


def _any_line(patterns) -> str:
    return "(?mdU)" + "|".join("^" + p for p in patterns)


# fixed values: what the first characters of a diff look like
PATCH_STARTS = (r"---\s+\S+", r"\+\+\+\s+\S+", r"@@\s+-\d+")
DIFF_STARTS = PATCH_STARTS + (r"diff\s+--git", r"Index:\s+")
DIFF_LINE_STARTS = (
    r"diff\s+--git", r"index\s+[0-9a-f]+", r"---\s+", r"\+\+\+\s+", r"@@\s+", r"[-+\s]",
    r"\\ No newline", "Binary files", "new file mode", "deleted file mode", "similarity index",
    "rename from", "rename to", "old mode", "new mode",
)


def looks_like_diff(text: Column) -> Column:
    return text.rlike(_any_line(DIFF_STARTS))


def is_valid_patch(text: Column) -> Column:
    return text.rlike(_any_line(PATCH_STARTS))


def is_diff_line(line: Column) -> Column:
    return line.rlike("(?dU)^(?:" + "|".join(DIFF_LINE_STARTS) + ")")


def content_id(repo: Column, problem: Column) -> Column:
    return F.left(F.sha2(F.concat(repo, F.lit(":"), problem).cast("binary"), 256), F.lit(12))


def generated_id(category: Column, problem: Column) -> Column:
    prefix = F.left(F.upper(F.replace(category, F.lit("_"), F.lit(""))), F.lit(3))
    return F.concat(prefix, F.lit("-"), F.left(F.sha2(problem.cast("binary"), 256), F.lit(8)))


def has_valid_id_format(instance_id: Column) -> Column:
    return instance_id.rlike(r"\A(?:[A-Z]+-[0-9]+|[a-z0-9_-]+)\z")


def is_generated_id(instance_id: Column) -> Column:
    return instance_id.rlike(r"\A[A-Z]+-[0-9a-f]{8}\z")


def status_marker(status: Column) -> Column:
    out = F
    for value, marker in C.STATUS_MARKER.items():
        out = out.when(status == value, marker)
    return out.otherwise(C.UNKNOWN_MARKER)


def percent(rate: Column) -> Column:
    return F.format_string("%.1f%%", rate * 100)


def test_file_of(full_name: Column) -> Column:
    """File part of 'file::name', null when there is none."""
    return F.when(F.contains(full_name, F.lit("::")), F.get(F.split(full_name, "::"), F.lit(0)))


def test_name_of(full_name: Column) -> Column:
    parts = F.split(full_name, "::")
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(full_name)


def is_test_file(path: Column) -> Column:
    """True when the path, or the path below any directory, fits one of the test-file globs."""
    alternatives = [re.escape(g).replace(r"\*", "[^/]*") for g in C.TEST_FILE_GLOBS]
    return path.rlike("(?:^|/)(?:" + "|".join(alternatives) + r")\z")


def truncate_log(text: Column, limit: int) -> Column:
    """Keep head and tail of a text longer than ``limit``. The tail of an odd limit is one
    character longer than the head; limit 0 keeps the whole text behind the mark."""
    head, tail = limit // 2, -((-limit) // 2)
    kept_tail = F.right(text, F.lit(tail)) if tail else text
    return F.when(
        F.length(text) > limit, F.concat(F.left(text, F.lit(head)), F.lit(C.TRUNCATION_MARK), kept_tail)
    ).otherwise(text)


def preview(text: Column, limit: int = 60) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def codes_that_hold(*pairs) -> Column:
    """Array of the codes whose condition is true, in the given order."""
    # no lambda: what one is part of is interpreted, and what checks share computed for each of them
    none = F.array().cast("array<string>")
    codes = [(cond, F.lit(code) if isinstance(code, str) else code) for cond, code in pairs]
    return F.flatten(F.array(*[F.when(cond & code.isNotNull(), F.array(code)).otherwise(none) for cond, code in codes]))
