"""Text, path and identifier functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Block comments without look-ahead, so that RE2 engines take the same pattern.
BLOCK_COMMENT = r"/\*[^*]*\*+([^/*][^*]*\*+)*/"
#: What no part of a location can hold, as `.` doesn't match it.
LINE_ENDS = ("\n", "\r", "\u0085", "\u2028", "\u2029")
LOCATION = r"file://(.*):(.*):.*:(.*):.*"


def strip_comments(t: Column) -> Column:
    """Line comments first, then block comments; neither knows of string literals."""
    return F.regexp_replace(F.regexp_replace(t, "//.*", ""), BLOCK_COMMENT, "")


def normalize(t: Column) -> Column:
    """Without comments, white space collapsed to single spaces, trimmed."""
    return F.trim(F.regexp_replace(strip_comments(t), r"\s+", " "))


def ident_tokens(name: Column) -> Column:
    """Lower-case parts of a camelCase or snake_case identifier."""
    return F.split(F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")), r"[_\s]+")


def token_key(name: Column) -> Column:
    return F.array_join(ident_tokens(name), "")


def common_suffix_length(a: Column, b: Column) -> Column:
    """Characters that both end in."""
    same = F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda k: F.right(a, k) == F.right(b, k))
    return F.when(a.isNotNull() & b.isNotNull(), F.array_max(same))


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def norm_path(path: Column) -> Column:
    """Without `.` parts, empty parts, and parts that a following `..` undoes; a leading slash stays."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def push(stack: Column, part: Column) -> Column:
        undo = (part == "..") & (F.size(stack) > 0) & (F.element_at(stack, -1) != "..")
        return F.when(undo, F.slice(stack, 1, F.size(stack) - 1)).when((part == "..") & path.startswith("/"), stack).otherwise(F.concat(stack, F.array(part)))

    whole = F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), push), "/"))
    return F.when(whole == "", ".").otherwise(whole)


def with_slash(url: Column) -> Column:
    return F.when(url.endswith("/"), url).otherwise(F.concat(url, F.lit("/")))


def key_value(x: Column) -> Column:
    """A struct of what is before and after the first `=`; no `=` gives an empty value."""
    p = F.split(x, "=", 2)
    return F.struct(F.get(p, F.lit(0)).alias("key"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("value"))


def newline_count(t: Column) -> Column:
    return F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))


def location(text: Column) -> Column:
    """file, start_line, end_line of a location literal; null where it doesn't match or names no file."""
    part = lambda k: F.regexp_extract(text, LOCATION, k)
    place = lambda file, start, end: F.struct(file.alias("file"), start.try_cast("int").alias("start_line"), end.try_cast("int").alias("end_line"))
    # LOCATION's first part is the longest that leaves four colons in its line: of one line that begins as a literal, parts are counted from its end, which costs less than matching
    plain = text.startswith("file://")
    for end in LINE_ENDS:
        plain = plain & ~text.contains(end)
    tail = F.substring_index(text, ":", -4)
    n = F.length(text) - F.length(tail) - 8
    counted = F.when(n > 0, place(F.substr(text, F.lit(8), n), F.substring_index(tail, ":", 1), F.substring_index(F.substring_index(tail, ":", -2), ":", 1)))
    return F.when(plain, counted).when(text.rlike(LOCATION) & (part(1) != ""), place(part(1), part(2), part(3)))


def includes(text: Column) -> Column:
    """Paths of include directives, quoted or in angle brackets."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"""#include\s*("[^"]+"|<[^>]+>)"""), F.lit(1)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


# The beginnings of messages that name an import.
IMPORT_ERRORS = (
    r"^unresolved imports? `(\S+)`",
    r"^failed to resolve: use of unresolved modules? or unlinked crates? `(\S+)`",
    r"^failed to resolve: .* `(\S+)` is not a crate or module",
)


def import_root(message: Column) -> Column:
    """The first segment of what an import error names; null for other messages."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(message, p, 1), F.lit("")) for p in IMPORT_ERRORS])
    return F.split_part(found, F.lit("::"), F.lit(1))


def strip_include(folder: Column, include: Column) -> Column:
    """folder, up by as many levels as it takes until include is no part of it."""
    up = F.transform(F.sequence(F.lit(0), F.size(F.split(folder, "/"))), lambda k: F.array_join(F.slice(F.split(folder, "/"), F.lit(1), F.greatest(F.size(F.split(folder, "/")) - k, F.lit(0))), "/"))
    return F.when(include == "", folder).otherwise(F.element_at(F.filter(up, lambda f: (f == "") | ~F.contains(f, include)), 1))


def non_blank(text: Column) -> Column:
    """Whether more than white space and separators stands in a text."""
    return F.translate(text, " \t\n,;{}", "") != ""


def exported(text: Column) -> Column:
    """Without test attributes' lines, and with the unsafe form of the no-mangle attribute."""
    return F.replace(F.regexp_replace(text, r"(?m)^\s*#\[test\]\s*?\n", ""), F.lit("#[no_mangle]"), F.lit("#[unsafe(no_mangle)]"))


def joined(*parts: Column, separator: str = "\n") -> Column:
    """The parts that aren't null or empty."""
    return F.concat_ws(separator, *[F.nullif(x, F.lit("")) for x in parts])


def registry_crate(path: Column) -> Column:
    """The crate's name in a path of the registry's sources."""
    return F.nullif(F.regexp_extract(path, r".*/\.cargo/registry/src/.*/([\w-]+)-\d+\.\d+\.\d+/.*", 1), F.lit(""))


def feature_gate(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, r"^the item is gated behind the `(.*)` feature", 1), F.lit(""))


def first_usable(*versions: Column) -> Column:
    """The first that is neither null, empty nor 0.0.0."""
    return F.coalesce(*[F.nullif(F.nullif(v, F.lit("")), F.lit("0.0.0")) for v in versions])


def token_count(t: Column) -> Column:
    """Four characters to a token, rounded up."""
    return F.ceil(F.length(t) / 4).cast("long")


def error_kind(message: Column, located: Column, outside: Column) -> Column:
    """Ordered rules over a message, the number of units it lies in, and whether a part lies outside the source."""
    crate = message.contains("crate") | message.contains("failed to resolve") | message.contains("unresolved import")
    inter = message.rlike("^cannot find .* in this scope") | message.rlike("^no .* found for .* in the current scope") | message.rlike("^.* call to .* function .*")
    return F.when(located > 1, "inter_unit").when(outside | crate, "external_crate").when(inter, "inter_unit").otherwise("intra_unit")


def is_test(names: Column) -> Column:
    """Whether some declared name begins with test_."""
    return F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.coalesce(n.startswith("test_"), F.lit(False)))


def is_typedef(kind: Column) -> Column:
    return kind == "CTypedefType"


def is_function(kind: Column) -> Column:
    return kind.endswith("Function")


def own_import(text: Column) -> Column:
    """Whether a piece imports from its own crate, which goes when pieces are put in normal form."""
    return F.coalesce(F.ltrim(text).startswith("use crate::"), F.lit(False))


def fenced_bodies(text: Column) -> Column:
    """The trimmed bodies of blocks from fence to next fence, wherever on a line these stand."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```[a-zA-Z]*(.*?)```"), F.lit(1)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def wrapped(kind: Column, name: Column, body: Column) -> Column:
    """A container's text: a head by its kind, its items, a tail; an enum's and a struct's items end in commas."""
    head = F.when(kind == "impl", F.concat(F.lit("impl "), name, F.lit(" {"))).when(kind == "struct", F.concat(F.lit("struct "), name, F.lit(" {"))).when(kind == "enum", F.concat(F.lit("enum "), name, F.lit(" {")))
    return F.when(head.isNotNull(), F.concat_ws("\n", head, body, F.lit("}"))).otherwise(body)


def separator(kind: Column) -> Column:
    """What stands between a container's items."""
    return F.when(kind.isin("struct", "enum"), ",\n").otherwise("\n")
