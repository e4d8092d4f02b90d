"""What a query's text says about itself: intent, file types, a path, synonyms; as columns over any table of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FILE_TYPES = dict(zip("go python py javascript js typescript ts rust rs java ruby rb cpp c swift kotlin kt markdown md".split(), ".go .py .py .js .js .ts .ts .rs .rs .java .rb .rb .cpp .c .swift .kt .kt .md .md".split()))
PLACES = ("in", "from", "under", "inside", "within")
SYNONYMS = {
    head: tuple(words.split(";"))
    for head, words in (
        line.split(": ")
        for line in """test: spec;testing;unit test;integration test
error: err;failure;exception;panic;fault
config: configuration;settings;options;prefs
auth: authentication;login;signin;authorization
create: new;add;insert;make;init
delete: remove;destroy;drop;erase
update: modify;change;edit;patch;set
get: fetch;retrieve;find;read;load
start: begin;launch;run;init;boot
stop: halt;end;terminate;shutdown;kill
connect: link;join;attach;bind
handle: process;manage;deal;serve""".split("\n")
    )
}


def fields(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def is_identifier(word: Column) -> Column:
    """Mixed case, an underscore or a dot."""
    return (word.rlike(r"\p{Lu}") & word.rlike(r"\p{Ll}")) | word.contains("_") | word.contains(".")


def analysis(text: Column) -> Column:
    """struct(intent, is_identifier, is_natural, file_types, path_prefix) of a query; a blank one is a search."""
    words = fields(text)
    n = F.size(words)
    ids = F.size(F.filter(words, is_identifier))
    half = F.floor(n / 2)
    definition, natural, reference = (n <= 2) & (ids == n), (n >= 4) & (ids < half), ids > half
    intent = F.when(n == 0, "search").when(definition, "definition").when(natural, "search").when(reference, "reference").otherwise("exploration")
    known = F.create_map(*(F.lit(x) for pair in FILE_TYPES.items() for x in pair))
    bare = lambda w: F.lower(F.regexp_replace(F.regexp_replace(w, r",$", ""), r"\.$", ""))
    types = F.array_distinct(F.filter(F.transform(words, lambda w: F.try_element_at(known, bare(w))), lambda x: x.isNotNull()))
    places = []
    for place in PLACES:
        after = F.trim(F.regexp_extract(text, rf"(?is)^.* {place} (.*)$", 1))
        path = F.regexp_replace(F.regexp_replace(after, r"\.$", ""), r",$", "")
        places.append(F.when((path != "") & ~path.contains(" "), path))
    return F.struct(intent.alias("intent"), ((n > 0) & (definition | (~natural & reference))).alias("is_identifier"), ((n > 0) & ~definition & natural).alias("is_natural"), types.alias("file_types"), F.coalesce(*places, F.lit("")).alias("path_prefix"))


def expansions(text: Column) -> Column:
    """The query, and the synonyms of its words in order."""
    known = F.create_map(*(x for head, words in SYNONYMS.items() for x in (F.lit(head), F.array(*map(F.lit, words)))))
    more = F.flatten(F.filter(F.transform(fields(text), lambda w: F.try_element_at(known, F.lower(w))), lambda x: x.isNotNull()))
    return F.concat(F.array(text), more)


def extension(path: Column) -> Column:
    """The lower-case extension with its dot; empty where the last part of the path has none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def last_words(text: Column, n: int) -> Column:
    """The last n words, joined by spaces."""
    words = fields(text)
    return F.array_join(F.when(F.size(words) > n, F.slice(words, -n, n)).otherwise(words), " ") if n > 0 else F.lit("")


def line_endings(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def signature(code: Column, most: int = 120) -> Column:
    """The first line that isn't blank, cut to `most` characters with an ellipsis."""
    line = F.trim(F.regexp_extract(code, r"^\s*(\S[^\n]*)", 1))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).otherwise(line)


def human_bytes(n: Column) -> Column:
    """Bytes in units of 1024 with one decimal."""
    out = F.when(n < 1024, F.format_string("%d B", n))
    for i, unit in enumerate("KMGTPE", 1):
        cond = n < 1024 ** (i + 1) if unit != "E" else F.lit(True)
        out = out.when(cond, F.format_string(f"%.1f {unit}B", n / float(1024**i)))
    return out


def one_line(text: Column, limit: int) -> Column:
    """White space as single spaces, cut to limit characters with an ellipsis where there is room for one."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    if limit <= 0:
        return flat
    short = F.substring(flat, 1, limit) if limit <= 3 else F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))
    return F.when(F.length(flat) <= limit, flat).otherwise(short)


def first_match(*conditions: tuple[Column, str]) -> Column:
    """The value of the first condition that holds."""
    return reduce(lambda a, b: a.when(*b), conditions[1:], F.when(*conditions[0]))
