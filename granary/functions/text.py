"""Column functions on text, paths and urls. All are built-in expressions, so plans stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is an identifier, a number, or one sign. Letters outside ASCII are no tokens by themselves.
TOKEN = r"[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+(?:\.[0-9]+)?|[^\s\p{Z}\p{L}\p{N}_]"
#: A longer token that begins with a letter counts as several.
LONG_TOKEN = 10

#: Symbol kinds of the language server protocol, from 1 on.
SYMBOL_KINDS = (
    "file module namespace package class method property field constructor enum interface function variable "
    "constant string number boolean array object key null enummember struct event operator typeparameter"
).split()

#: Languages by file extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cxx": "cpp",
    "cc": "cpp", "hpp": "cpp", "cs": "csharp", "php": "php", "kt": "kotlin", "kts": "kotlin", "rb": "ruby",
    "html": "html", "htm": "html", "css": "css", "scss": "css", "less": "css",
}

STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "is", "for", "with", "on", "by", "be", "as", "at", "it", "that", "this", "from")


def token_weight(token: Column) -> Column:
    size = F.length(token)
    count = F.greatest(F.lit(1), F.floor(size / 4))
    pieces = F.ceil(size / F.floor(size / count))
    return F.when((size > LONG_TOKEN) & token.rlike("^[a-zA-Z]"), pieces).otherwise(F.lit(1)).cast("int")


def token_count(text: Column) -> Column:
    """Tokens of a text; null counts as empty."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.aggregate(tokens, F.lit(0), lambda n, t: n + token_weight(t))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def truncate_tokens(text: Column, limit: int) -> Column:
    """The text if it has limit tokens or fewer, else as many whole words as fit, joined by spaces.

    Counts add up over words, so one running sum over the words, split once, finds both; beyond the limit nothing is
    counted any more.
    """
    start = F.struct(F.lit(0).alias("tokens"), F.lit(0).alias("kept"), F.lit(True).alias("fits"))

    def step(acc: Column, word: Column) -> Column:
        tokens = F.when(acc.fits, acc.tokens + token_count(word)).otherwise(acc.tokens)
        fits = acc.fits & (tokens <= limit)
        return F.struct(tokens.alias("tokens"), F.when(fits, acc.kept + 1).otherwise(acc.kept).alias("kept"), fits.alias("fits"))

    def cut(ws: Column) -> Column:
        found = F.transform(F.array(F.aggregate(ws, start, step)), lambda f: F.when(f.fits, text).otherwise(F.array_join(F.slice(ws, F.lit(1), f.kept), " ")))
        return F.element_at(found, 1)

    return F.element_at(F.transform(F.array(words(text)), cut), 1)


def chunk_id(uri: Column, start: Column, end: Column) -> Column:
    return F.sha2(F.concat_ws(":", uri, start.cast("string"), end.cast("string")), 256)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 8)


def code_corpus(uri: Column) -> Column:
    return F.when(F.lower(uri).contains("test"), "CODE_TEST").otherwise("CODE_LOGIC")


def doc_corpus(uri: Column) -> Column:
    return F.when(F.upper(uri).contains("README"), "DOC_README").otherwise("DOC_DESIGN")


def talk_corpus(uri: Column) -> Column:
    return F.when(F.lower(uri).contains("slack"), "CONVO_SLACK").otherwise("CONVO_TRANSCRIPT")


def doc_class(path: Column) -> Column:
    p = F.lower(path)
    return (
        F.when(p.contains("runbook"), "RUNBOOK")
        .when(p.rlike("(^|/)adr(/|-)|decision"), "ADR")
        .when(p.contains("readme") | p.contains("docs/"), "DOC_README")
        .otherwise("DOC_DESIGN")
    )


def url_service(url: Column) -> Column:
    """The host, up to a slash or colon; null for this machine's own addresses and for what is no url."""
    host = F.regexp_extract(url, "https?://([^/:]+)", 1)
    return F.when((host != "") & ~host.isin("localhost", "127.0.0.1", "0.0.0.0"), host)


def url_path(url: Column) -> Column:
    """The path, up to a quote, closing bracket or white space; null without a service or path."""
    path = F.regexp_extract(url, r"https?://[^/]+(/[^\"')\s]*)", 1)
    return F.when(url_service(url).isNotNull() & (path != ""), path)


def normal_path(path: Column) -> Column:
    """Without query and trailing slashes; empty becomes the root."""
    bare = F.regexp_replace(F.substring_index(path, "?", 1), "/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


def slug(text: Column) -> Column:
    """Lower case, other signs than letters and digits as single hyphens; over 50 signs: 45, without hyphens at their
    end, and four of a hash."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    short = F.concat(F.regexp_replace(F.substring(plain, 1, 45), "-+$", ""), F.lit("-"), F.substring(F.sha2(text, 256), 1, 4))
    return F.when(F.length(plain) > 50, short).otherwise(plain)


def kind_name(kind: Column) -> Column:
    names = F.array(*map(F.lit, SYMBOL_KINDS))
    return F.when(kind.between(1, len(SYMBOL_KINDS)), F.try_element_at(names, kind.cast("int"))).otherwise("unknown")


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("unknown"))


def code_words(text: Column, split_identifiers: bool = True) -> Column:
    """Lower-case words for search, identifiers cut at case changes and underscores, stop words left out."""
    t = F.coalesce(text, F.lit(""))
    if split_identifiers:
        t = F.regexp_replace(t, "([a-z0-9])([A-Z])", "$1 $2")
    parts = F.split(F.lower(t), "[^a-z0-9]+" if split_identifiers else "[^a-z0-9_]+")
    return F.filter(parts, lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def snippet(text: Column, lines: int) -> Column:
    parts = F.split(text, "\n")
    more = F.size(parts) - lines
    return F.when(more > 0, F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.lit("\n... ("), more.cast("string"), F.lit(" more lines)"))).otherwise(text)


def occurrences(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def line_ending(text: Column) -> Column:
    crlf = text.contains("\r\n")
    bare = F.replace(text, F.lit("\r\n"), F.lit("")).contains("\n")
    return F.when(crlf & bare, "mixed").when(crlf, "crlf").when(bare, "lf").otherwise("none")


def balanced(text: Column) -> Column:
    pairs = [occurrences(text, a) == occurrences(text, b) for a, b in ("()", "[]", "{}")]
    return pairs[0] & pairs[1] & pairs[2]


def front_matter(text: Column, key: str) -> Column:
    """A key's value from the block between --- lines at the text's beginning; null without."""
    head = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    value = F.regexp_extract(head, rf"(?m)^{key}:[ ]*(.*)$", 1)
    return F.when(value != "", value)


def file_uri(path: Column) -> Column:
    """Of an absolute path: percent signs are escaped, and backslashes are slashes."""
    return F.concat(F.lit("file://"), F.replace(F.replace(path, F.lit("%"), F.lit("%25")), F.lit("\\"), F.lit("/")))


def uri_path(uri: Column) -> Column:
    """The path of a file uri, with its escapes resolved; anything else stays as it is."""
    plain = F.replace(F.substr(uri, F.lit(8)), F.lit("+"), F.lit("%2B"))  # a plus sign is no space here
    return F.when(uri.startswith("file://"), F.coalesce(F.try_url_decode(plain), F.substr(uri, F.lit(8)))).otherwise(uri)


def mentions(text: Column) -> Column:
    """Words that begin with @, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"@[A-Za-z0-9_.-]+"), F.lit(0))


def hover_text(contents: Column) -> Column:
    """Hover contents as JSON: a string, an object with a value, or a list of either, its items joined by line ends."""
    value = lambda c: F.when(c.startswith("{"), F.coalesce(F.get_json_object(c, "$.value"), F.lit(""))).otherwise(c)
    items = F.from_json(contents, "array<string>")
    alone = F.get_json_object(F.concat(F.lit("["), contents, F.lit("]")), "$[0]")
    return F.when(contents.startswith("["), F.array_join(F.transform(items, value), "\n")).otherwise(value(alone))
