"""Text functions of the retrieval operators, as Column expressions, each with the DuckDB SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that queries ignore, and those that code ignores besides.
QUERY_STOPWORDS = "a an the is it of in to for on and or not with as by at from be this that".split()
CODE_STOPWORDS = [*QUERY_STOPWORDS, *"if else return package import func type struct interface var const chan defer select case default switch range break continue goto fallthrough".split()]

RAW = r"[\p{L}\p{Nd}_\-./\\]+"
EDGES = "._-/\\"
SPLITS = r"[\p{Lu}\p{Nd}_\-./\\]"
BOUNDARY = r"(?<=\p{Nd})(?=\P{Nd})|(?<=\P{Nd})(?=\p{Nd})|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


def raw_tokens(text: Column) -> Column:
    """Maximal runs of letters, digits and _ - . / \\."""
    return F.regexp_extract_all(text, F.lit(RAW), F.lit(0))


def split_identifier(token: Column) -> Column:
    """Parts at camel-case and digit boundaries, lower case, over one byte, distinct."""
    return F.array_distinct(F.filter(F.transform(F.split(token, BOUNDARY), F.lower), lambda t: F.octet_length(t) > 1))


def expand_token(token: Column) -> Column:
    """A raw token as its distinct terms: itself, its parts between separators, and their parts at identifier boundaries."""
    parts = F.split(token, r"[_\-./\\]+")
    every = F.concat(F.array(token), parts, F.flatten(F.transform(parts, lambda p: F.split(p, BOUNDARY))))
    long = lambda t: F.octet_length(t) > 1
    # most tokens have nothing to split at, and split() compiles its pattern for each
    return F.when(F.rlike(token, F.lit(SPLITS)), F.array_distinct(F.filter(F.transform(every, lambda t: F.lower(F.btrim(t, F.lit(EDGES)))), long))).otherwise(F.filter(F.array(F.lower(token)), long))


def terms(text: Column, stopwords: list[str] = CODE_STOPWORDS) -> Column:
    """All terms of a text, as often as its raw tokens give them."""
    return F.filter(F.flatten(F.transform(raw_tokens(F.coalesce(text, F.lit(""))), expand_token)), lambda t: ~t.isin(stopwords))


def query_terms(text: Column) -> Column:
    return F.array_distinct(terms(text, QUERY_STOPWORDS))


def normalize(text: Column) -> Column:
    """Lower case, a-z and 0-9 only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def code_size(text: Column) -> Column:
    """Tokens of source code: each of ( ) { } [ ] ; , . : and every run of other characters between white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[(){}\[\];,.:]|[^ \t\n\r(){}\[\];,.:]+"), F.lit(0)))


def last_selector(symbol: Column) -> Column:
    """What follows the last dot; the symbol itself without one, or if it ends with one."""
    return F.when(F.endswith(symbol, F.lit(".")), symbol).otherwise(F.substring_index(symbol, ".", -1))


def node_id(pkg: Column, recv: Column, name: Column) -> Column:
    return F.concat(pkg, F.lit("."), F.when(F.coalesce(recv, F.lit("")) != "", F.concat(F.lit("("), recv, F.lit(")."))).otherwise(""), name)


def exported(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^\p{Lu}"), F.lit(False))


def trimmed(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(" \t\r\n\x0b\x0c"))


def meaningful(text: Column) -> Column:
    """Trimmed lines that are neither empty nor line comments."""
    return F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: (x != "") & ~F.startswith(x, F.lit("//")))


def use_kind(kind: Column) -> Column:
    return F.when(kind == 0, "read").when(kind == 1, "write").when(kind == 2, "call_arg").when(kind == 3, "return").otherwise("unknown")


def type_label(kind: Column) -> Column:
    return F.when(kind == "5", "struct").when(kind == "6", "interface").when(kind == "8", "class").when(kind == "9", "enum").otherwise("type")


def sql_split(part: str) -> str:
    """DuckDB SQL for the identifier boundaries: it has no look-behind, so blanks are put between instead."""
    for a, b in ((r"(\p{Lu})(\p{Lu}\p{Ll})", r"\1 \2"), (r"(\p{Ll})(\p{Lu})", r"\1 \2"), (r"(\p{Nd})([^\p{Nd}\s])", r"\1 \2"), (r"([^\p{Nd}\s])(\p{Nd})", r"\1 \2")):
        part = f"regexp_replace({part}, '{a}', '{b}', 'g')"
    return part


def sql_terms(text: str, stopwords: list[str] = CODE_STOPWORDS) -> str:
    """DuckDB SQL for terms(text), as a list."""
    stop = ", ".join(f"'{w}'" for w in stopwords)
    parts = r"regexp_split_to_array(w, '[_\-./\\]+')"
    every = f"list_concat(list_concat([w], {parts}), flatten(list_transform({parts}, lambda p: string_split({sql_split('p')}, ' '))))"
    one = f"list_distinct(list_filter(list_transform({every}, lambda x: lower(trim(x, '._-/\\'))), lambda x: strlen(x) > 1))"
    return f"list_filter(flatten(list_transform(regexp_extract_all(coalesce({text}, ''), '{RAW}'), lambda w: {one})), lambda x: x not in ({stop}))"


def package_of(path: Column) -> Column:
    """The folder that holds a file of a clean path; main for none."""
    folder = F.regexp_extract(path, r"([^/]+)/+[^/]*$", 1)
    return F.when(folder.isin("", ".", ".."), F.when(F.startswith(path, F.lit("/")), "/").otherwise("main")).otherwise(folder)


def def_id(pkg: Column, file: Column, line: Column, name: Column) -> Column:
    return F.concat(pkg, F.lit("."), file, F.lit(":"), line.cast("string"), F.lit(":"), name)


def use_id(definition: Column, kind: Column) -> Column:
    return F.concat(definition, F.lit(":"), use_kind(kind))


def rfc3339(ts: Column) -> Column:
    """A time in the session's zone."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def duration(micros: Column) -> Column:
    """Whole microseconds as text: '< 1µs', '12µs', and from a millisecond on hours, minutes, seconds to the millisecond."""
    ms = F.round(micros / 1000).cast("long")
    part = lambda c: F.floor(c).cast("string")
    left = F.rtrim(F.lpad((ms % 1000).cast("string"), 3, "0"), F.lit("0"))
    seconds = F.concat(part(ms % 60_000 / 1000), F.when(left != "", F.concat(F.lit("."), left)).otherwise(""), F.lit("s"))
    minutes = F.when(ms >= 60_000, F.concat(part(ms % 3_600_000 / 60_000), F.lit("m"))).otherwise("")
    hours = F.when(ms >= 3_600_000, F.concat(part(ms / 3_600_000), F.lit("h"))).otherwise("")
    long = F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.concat(hours, minutes, seconds))
    return F.when(micros < 1, "< 1µs").when(micros < 1000, F.concat(micros.cast("string"), F.lit("µs"))).otherwise(long)


def index_summary(mode: Column, indexed: Column, deleted: Column, updated: Column) -> Column:
    """What the last sync did; 'unavailable' where nothing is known."""
    named = F.when(F.coalesce(mode, F.lit("")) == "", "unknown").otherwise(mode)
    none = (F.coalesce(mode, F.lit("")) == "") & (indexed == 0) & (deleted == 0) & updated.isNull()
    return F.when(none, "unavailable").otherwise(F.concat(named, F.lit(": indexed="), indexed.cast("string"), F.lit(" deleted="), deleted.cast("string"), F.lit(" updated_at="), F.coalesce(rfc3339(updated), F.lit(""))))
