"""Text functions as column expressions, all of them within the JVM.

Patterns whose matches the semantics fix (tokens, comments, formulas, sentence ends, marks of pages, fields and
attempts) are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Characters that compatibility composition may change, or a mark that may join the one before; Latin letters aren't.
_COMPATIBLE = "[^\\x00-\\x7F\u00c0-\u00ff]"


def _normalized(text: Column, way: str, needs: str) -> Column:
    """By the normalizer that Spark ships for its collations; only texts that need it are given to it."""
    return F.when(text.rlike(needs), F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit(way), text, F.lit(True))).otherwise(text)


def nfkc(text: Column) -> Column:
    """Compatibility composition."""
    return _normalized(text, "compose", _COMPATIBLE)


def unaccented(text: Column) -> Column:
    """Lower case without accents, other characters beyond ASCII dropped."""
    return F.regexp_replace(_normalized(F.lower(text), "decompose", "[^\\x00-\\x7F]"), "[^\\x00-\\x7F]", "")


def tokens(text: Column) -> Column:
    """Runs of two and more ASCII letters and digits, lower case; a TeX command is a word of its own."""
    plain = F.regexp_replace(F.lower(nfkc(text)), r"\\([a-z]+)", " $1 ")
    return F.coalesce(F.regexp_extract_all(plain, F.lit("([a-z0-9]{2,})"), F.lit(1)), F.array().cast("array<string>"))


def bag(text: Column) -> Column:
    """Words of three and more ASCII letters in lower case, TeX commands left out."""
    plain = F.regexp_replace(F.lower(nfkc(text)), r"\\[a-z]+", " ")
    return F.coalesce(F.regexp_extract_all(plain, F.lit("([a-z]{3,})"), F.lit(1)), F.array().cast("array<string>"))


def squeezed(text: Column) -> Column:
    """Lower case; whatever is no ASCII letter or digit becomes a blank, and blanks run together."""
    return F.trim(F.regexp_replace(F.lower(nfkc(text)), r"[^a-z0-9]+", " "))


def fingerprint16(text: Column) -> Column:
    """First 16 hex digits of the SHA-1."""
    return F.substring(F.sha1(text.cast("binary")), 1, 16)


def slug(text: Column, most: int = 60, default: str = "apuntes") -> Column:
    """ASCII letters and digits joined by hyphens; text must be without accents, see ``unaccented``."""
    made = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(made, 1, most), r"-+$", ""), F.lit("")), F.lit(default))


def without_comments(tex: Column) -> Column:
    """TeX without comments; an escaped percent sign stays."""
    return F.regexp_replace(tex, r"(?m)(?<!\\)%.*", "")


def plain_text(tex: Column) -> Column:
    """TeX without displays, formulas, references, commands, braces and brackets."""
    # The environments and commands that go with what they hold.
    out = F.regexp_replace(tex, r"(?s)\\begin\{(equation|align|gather|multline|eqnarray)\*?\}.*?\\end\{\1\*?\}", " ")
    out = F.regexp_replace(out, r"(?s)\$\$.*?\$\$|\\\[.*?\\\]|\$[^$]*\$", " ")
    out = F.regexp_replace(out, r"\\(?:label|ref|eqref|cite|index)\{[^}]*\}", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\\[a-zA-Z]+\*?", " "), r"[{}~\[\]]", " ")


def sentences(text: Column) -> Column:
    """Parts of a text that end with a full stop, semicolon or colon before a capital, a command or a formula."""
    return F.split(text, r"(?<=[.;:])\s+(?=[A-Z\\$(])")


def words_over(text: Column, least: int) -> Column:
    """Distinct words of more than ``least`` characters of the squeezed text."""
    return F.array_distinct(F.filter(F.split(squeezed(text), " "), lambda w: F.length(w) > least))


def jaccard(a: Column, b: Column) -> Column:
    """Share of two word sets' union that both have; 0 where there is none."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def contained_share(words: Column, text: Column) -> Column:
    """Share of words that are somewhere in text, within other words too."""
    return F.coalesce(F.size(F.filter(words, lambda w: F.contains(text, w))) / F.nullif(F.size(words), F.lit(0)), F.lit(0.0))


def page_ranges(ranges: Column, total: Column) -> Column:
    """'1-3,5' as ascending page numbers within 1..total; all pages where empty. Fails on anything else."""
    parts = F.split(F.regexp_replace(ranges, r"\s", ""), ",")

    def pages(part: Column) -> Column:
        a = F.try_to_number(F.regexp_extract(part, r"^(\d+)", 1), F.lit("999999999")).cast("int")
        b = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(part, r"^\d+-(\d+)$", 1), F.lit("")), F.lit("999999999")).cast("int"), a)
        low, high = F.greatest(a, F.lit(1)), F.least(b, total)
        good = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
        return F.when(part.rlike(r"^\d+(-\d+)?$"), good).otherwise(F.raise_error(F.concat(F.lit("not a page range: "), part)).cast("array<int>"))

    everything = F.when(total >= 1, F.sequence(F.lit(1), F.greatest(total, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.when(F.trim(F.coalesce(ranges, F.lit(""))) == "", everything).otherwise(F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages)))))


def header_fields(text: Column) -> Column:
    """The map of a leading block of ``key: value`` lines between two lines of three hyphens."""
    head = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[^:]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]+):", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]+:", "")).alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["k"] != ""))


def raw_head(text: Column) -> Column:
    """A leading block between two lines of three hyphens as it stands where it can't be read as fields, else null.

    Lines that can be read are ``key: value``, items and continuations that begin with white space or a hyphen, comments, and blank ones.
    """
    head = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    odd = F.exists(F.split(head, r"\r?\n"), lambda x: ~x.rlike(r"^([^:]+:(\s.*)?|[\s-].*|#.*|)$"))
    return F.when(odd, head)


def body(text: Column) -> Column:
    """A text without its leading header block."""
    return F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---[ \t]*\r?\n?", "")


def with_field(fields: Column, key: str, value: Column) -> Column:
    """fields with key set, added if missing."""
    return F.map_concat(F.map_filter(fields, lambda k, v: k != key), F.create_map(F.lit(key), value))


def without_field(fields: Column, key: str) -> Column:
    return F.map_filter(fields, lambda k, v: k != key)


def replaced_field(fields: Column, key: str, value: Column) -> Column:
    """fields with key set only where it is there already."""
    return F.when(F.map_contains_key(fields, key), with_field(fields, key, value)).otherwise(fields)


def cited_keys(tex: Column) -> Column:
    """Distinct keys of citations, in order."""
    found = F.regexp_extract_all(tex, F.lit(r"\\cite[a-z]*\*?(?:\[[^\]]*\])*\{([^}]*)\}"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(found, lambda x: F.split(x, ","))), lambda x: F.trim(x)), lambda k: k != ""))


def topic(line: Column) -> Column:
    """The topic of a gap's line: what follows the last bar, up to a colon, in lower case."""
    return F.lower(F.trim(F.substring_index(F.element_at(F.split(line, r"\|"), -1), ":", 1)))


def stripped(text: Column) -> Column:
    """text without white space at its ends."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def section(text: Column, name: str, level: int = 2) -> Column:
    """The body of the first section of this heading."""
    mark = "#" * level
    return stripped(F.regexp_extract(text, rf"(?ms)^{mark} {name}[ \t]*$\n?(.*?)(?=^#{{1,{level}}} |\z)", 1))


def doubts(text: Column) -> Column:
    """(illegible, doubtful): numbers of the two marks in a transcription."""
    return F.struct(F.regexp_count(text, F.lit(r"\[ILEGIBLE\]")).alias("illegible"), F.regexp_count(text, F.lit(r"\[\?\]")).alias("doubtful"))


def json_object(text: Column) -> Column:
    """The JSON object in a model's reply: from the first brace to the last; null where there is none."""
    return F.when(F.try_parse_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1)).isNotNull(), F.regexp_extract(text, r"(?s)(\{.*\})", 1))
