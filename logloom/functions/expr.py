"""Scalar rules as Column expressions: they stay in the JVM and inside code generation where Spark can."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- text -----------------------------------------------------------------------------------------------------

#: Terminal escapes by their standard: control sequences (parameter, intermediate and final bytes), control strings up to their terminator, and two-character escapes.
_CONTROL_SEQUENCE = r"\x1b\[[0-?]*[ -/]*[@-~]"
_CONTROL_STRING = r"\x1b[\]PX^_][^\x07\x1b]*(?:\x07|\x1b\\)"
_ESCAPES = f"{_CONTROL_SEQUENCE}|{_CONTROL_STRING}|" + r"\x1b[ -~]"
#: Markers that may open a markdown line: headings, bullets and numbers, with quotes and blanks anywhere between.
_LINE_HEAD = r"^[\s>]*(?:(?:#{1,6}|[-*+]|[0-9]{1,9}[.)])[\s>]+)*"


def strip(text: Column) -> Column:
    """Without white space at either end (F.trim takes blanks only)."""
    return F.btrim(text, F.lit(" \t\n\r\f"))


def strip_ansi(text: Column) -> Column:
    """Terminal escapes removed: control sequences, operating-system commands, then any two-character escape."""
    return F.regexp_replace(text, _ESCAPES, "")


def title_line(text: Column) -> Column:
    """The first line with a letter or digit, without its markdown block markers; '' if none."""
    lines = F.transform(F.split(text, "\n"), lambda x: strip(F.regexp_replace(x, _LINE_HEAD, "")))
    return F.coalesce(F.get(F.filter(lines, lambda x: x.rlike(r"[\p{L}\p{N}]")), F.lit(0)), F.lit(""))


def prose_only(text: Column, elements: list[str]) -> Column:
    """Text without the named envelope elements; a stray tag goes, its text stays."""
    names = "|".join(elements)
    x = F.regexp_replace(text, rf"(?s)<({names})>.*?</\1>", " ")
    return strip(F.regexp_replace(x, rf"</?(?:{names})>", " "))


def clip(text: Column, size: int) -> Column:
    return F.substring(text, 1, size)


def title_or(text: Column, fallback: Column, size: int = 140) -> Column:
    """The text's title line, else the fallback, clipped."""
    return clip(F.coalesce(F.nullif(title_line(text), F.lit("")), fallback), size)


def excerpt(text: Column, size: int) -> Column:
    """struct(excerpt, truncated)."""
    return F.struct(clip(text, size).alias("excerpt"), (F.length(text) > size).alias("truncated"))


def contains_any(needle: str, *columns: Column) -> Column:
    """Case-insensitive substring test over several columns; nulls never match."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False))
    return out


#: Words that don't tell two log entries apart (fixed values).
CONTENT_STOPWORDS = (
    "about", "after", "again", "before", "being", "below", "between", "cannot", "could", "doing", "during", "each",
    "every", "first", "should", "their", "there", "these", "thing", "those", "through", "under", "until", "where",
    "which", "while", "would",
)


def content_words(text: Column) -> Column:
    """Different words of five or more letters, digits and hyphens, without those that say little."""
    return F.array_except(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9-]{5,}"), F.lit(0)), F.array(*map(F.lit, CONTENT_STOPWORDS)))


def date_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0)))


def quoted_phrases(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit('"([^"]{4,})"'), F.lit(1))


_SUPERSEDES = r"(?is)(?:\|\s*)?supersedes:\s*(.+?)\s*$"


def split_supersedes(text: Column) -> Column:
    """struct(text, supersedes) of an entry with an optional trailing 'supersedes: ...'."""
    found = F.regexp_extract(text, _SUPERSEDES, 1)
    rest = F.trim(F.regexp_replace(F.regexp_replace(text, _SUPERSEDES, ""), r"\|\s*$", ""))
    return F.struct(rest.alias("text"), F.nullif(F.trim(found), F.lit("")).alias("supersedes"))


def query_terms(query: Column) -> Column:
    """Search terms of a user's query: lower-cased words without trailing hyphens, each meant as a prefix."""
    words = F.split(F.lower(query), r"[^\p{L}\p{N}_-]+")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"-+$", "")), lambda w: F.length(w) > 0)


# --- names ----------------------------------------------------------------------------------------------------


def project_path(encoded: Column) -> Column:
    """A project folder's name with its leading hyphen read as the root."""
    return F.when(encoded.startswith("-"), F.concat(F.lit("/"), F.substring(encoded, 2, 1 << 30))).otherwise(encoded)


def tool_name(name: Column, prefix: str = "mcp__") -> Column:
    """struct(server, tool) of prefix + server + '__' + tool, both non-empty; else null."""
    rest = F.substring(name, len(prefix) + 1, 1 << 30)
    at = F.locate("__", rest)
    server, tool = F.substring(rest, F.lit(1), at - 1), F.substring(rest, at + 2, F.lit(1 << 30))
    ok = name.startswith(prefix) & (at > 1) & (F.length(tool) > 0)
    return F.when(ok, F.struct(server.alias("server"), tool.alias("tool")))


def canonical_key(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def server_naming(segment: Column, connector: str = "connector_", plugin: str = "plugin_") -> Column:
    """struct(key, origin, bare_key): prefixes are parameters; a plugin's segment must have three parts."""
    parts = F.split(segment, "_")
    bare = (
        F.when(segment.startswith(connector), canonical_key(F.substring(segment, len(connector) + 1, 1 << 30)))
        .when(segment.startswith(plugin) & (F.size(parts) == 3), canonical_key(F.get(parts, F.lit(2))))
    )
    origin = F.when(segment.startswith(connector), "connector").when(segment.startswith(plugin), "plugin")
    return F.struct(
        canonical_key(segment).alias("key"),
        F.coalesce(origin, F.lit("plain")).alias("origin"),
        F.nullif(bare, F.lit("")).alias("bare_key"),
    )


#: Endings of script files, and programs that only run something else (fixed values).
SCRIPT_ENDINGS = ("sh", "mjs", "js", "ts", "py", "rb", "zsh", "bash")
RUNNERS = ("sh", "bash", "zsh", "node", "npx", "python", "python3", "command", "test", "exec", "eval", "if", "while", "[")


def hook_label(command: Column, size: int = 48) -> Column:
    """What a command is called: the first script file it names; else its program, if the line is one plain call; else the start of the line."""
    words = F.filter(F.split(command, r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.substring_index(F.regexp_replace(w, r"^[^\w./-]+|[^\w./-]+$", ""), "/", -1))
    scripts = F.filter(bare, lambda b: b.contains(".") & F.substring_index(b, ".", -1).isin(*SCRIPT_ENDINGS))
    line, head = F.array_join(words, " "), F.get(words, F.lit(0))
    plain = ~head.contains("=") & ~head.isin(*RUNNERS) & ~line.rlike("[|;<>]|&&")
    program = F.when(plain, F.nullif(F.substring_index(head, "/", -1), F.lit("")))
    short = F.when(F.length(line) > size, F.concat(F.substring(line, 1, size - 3), F.lit("..."))).otherwise(line)
    return F.coalesce(F.get(scripts, F.lit(0)), program, short)


def link_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s_]+", "-")


def links_of(body: Column) -> Column:
    """Names in double brackets, without labels: they start with a letter or digit and hold those, blanks and . _ / - only."""
    inside = F.regexp_extract_all(body, F.lit(r"\[\[([^\[\]\n]+)\]\]"), F.lit(1))
    names = F.filter(F.transform(inside, lambda x: F.substring_index(x, "|", 1)), lambda x: x.rlike("^[A-Za-z0-9][A-Za-z0-9 ._/-]*$"))
    return F.array_distinct(F.transform(names, lambda x: F.trim(x)))


def launch_mode(status: Column, is_async: Column) -> Column:
    """From the result alone: its status, else its flag, else unknown."""
    return (
        F.when(status.isin("async_launched", "remote_launched"), "background")
        .when(status.isin("completed"), "foreground")
        .when(is_async, "background")
        .when(~is_async, "foreground")
        .otherwise("unknown")
    )


def is_dispatch(name: Column, specialist: Column) -> Column:
    return F.coalesce(specialist.isNotNull() | name.isin("Task", "Agent"), F.lit(False))


def step_signature(kind: Column, role: Column, tools: Column) -> Column:
    return F.concat_ws("|", kind, role, F.array_join(F.array_sort(tools), ","))


def path_digest(path: Column, width: int = 16) -> Column:
    return F.substring(F.sha2(path, 256), 1, width)


def url_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def has_suffix(path: Column, suffixes: list[str]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | F.lower(path).endswith(s)
    return out


def front_matter(text: Column, key: str) -> Column:
    """One scalar of a leading '---' block."""
    head = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    value = F.regexp_extract(head, rf"(?m)^\s*{key}:\s*(.*?)\s*$", 1)
    return F.nullif(F.regexp_replace(value, r"""^["']|["']$""", ""), F.lit(""))


def body_of(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", ""))


def stamp_of_name(name: Column) -> Column:
    """The time in a file name that starts with 14 digits."""
    return F.try_to_timestamp(F.regexp_extract(name, r"^(\d{14})", 1), F.lit("yyyyMMddHHmmss"))


def slug_of_name(name: Column) -> Column:
    return F.regexp_extract(name, r"^\d{14}-(.*?)(?:-[0-9a-f]{6,})?\.md$", 1)


# --- numbers and time -----------------------------------------------------------------------------------------


def half_up(x: Column, digits: int) -> Column:
    """Rounding half up, also for negative numbers."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def nearest_rank(x: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})")


def upper_median(x: str) -> Column:
    """The element at floor(n / 2) in ascending order."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x} DESC)")


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days, rounded down."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000)).cast("long")


def age_band(days: Column) -> Column:
    return (
        F.when(days <= 1, "today").when(days <= 7, "week").when(days <= 31, "month").when(days <= 92, "quarter")
        .when(days.isNotNull(), "stale")
    )


def staleness(days: Column) -> Column:
    return F.when(days.isNull(), "never").when(days <= 30, "active").when(days <= 90, "cooling").otherwise("stale")


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def days_since_month_end(month: Column, now: Column) -> Column:
    return F.datediff(now.cast("date"), F.last_day(F.to_date(month, "yyyy-MM")))


def entry_window(raw: Column) -> Column:
    """[start, end) of a log date: a bare date is the whole day, a full time is a moment."""
    bare = raw.rlike(r"^\d{4}-\d{2}-\d{2}$")
    start = F.try_to_timestamp(raw)
    return F.when(
        start.isNotNull(),
        F.struct(start.alias("start"), F.when(bare, start + F.expr("INTERVAL 1 DAY")).otherwise(start).alias("end")),
    )


def cost_of(tokens: str, rate_in: Column, rate_out: Column) -> Column:
    """struct of dollars for a token struct; null where the rate is. Cache reads cost 0.1 and writes 1.25 of the input rate."""
    t = lambda n: F.col(f"{tokens}.{n}")
    parts = {
        "input": t("input") * rate_in / 1e6,
        "output": t("output") * rate_out / 1e6,
        "cache_read": t("cache_read") * rate_in * 0.1 / 1e6,
        "cache_creation": t("cache_creation") * rate_in * 1.25 / 1e6,
    }
    total = parts["input"] + parts["output"] + parts["cache_read"] + parts["cache_creation"]
    return F.struct(*[v.alias(k) for k, v in parts.items()], total.alias("total"))


def numeric_only(m: Column) -> Column:
    """A map<string, variant>'s finite numbers as doubles; all other values go."""
    x = F.transform_values(m, lambda k, v: F.try_variant_get(v, "$", "double"))
    kind = lambda v: F.schema_of_variant(v)
    ok = F.map_filter(m, lambda k, v: kind(v).rlike("^(BIGINT|DOUBLE|DECIMAL)"))
    return F.map_filter(x, lambda k, v: F.array_contains(F.map_keys(ok), k))


def map_total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x)


# --- variants -------------------------------------------------------------------------------------------------


def typed(v: str, path: str, kind: str) -> Column:
    """A field of a variant if its JSON type is the asked one (string, number, boolean); no casts between types."""
    schema = {"string": "^STRING$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$"}[kind]
    target = {"string": "string", "number": "double", "boolean": "boolean"}[kind]
    field = F.try_variant_get(F.col(v), path, "variant")
    return F.when(F.schema_of_variant(field).rlike(schema), F.try_variant_get(F.col(v), path, target))


def content_text(v: str, path: str = "$.message.content") -> Column:
    """A message's content: the string itself, or the text blocks joined by blank lines."""
    c = F.try_variant_get(F.col(v), path, "variant")
    as_list = F.try_variant_get(F.col(v), path, "array<variant>")
    texts = F.transform(
        F.filter(as_list, lambda b: F.try_variant_get(b, "$.type", "string") == "text"),
        lambda b: F.try_variant_get(b, "$.text", "string"),
    )
    return F.coalesce(
        F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(F.col(v), path, "string")),
        F.array_join(texts, "\n\n"),
        F.lit(""),
    )


def usage_tokens(v: str) -> Column:
    """The four token tiers of a message; null without a usage object, 0 for a missing or wrongly typed tier."""
    usage = F.try_variant_get(F.col(v), "$.message.usage", "variant")
    tier = lambda f: F.coalesce(typed(v, f"$.message.usage.{f}", "number"), F.lit(0)).cast("long")
    return F.when(
        F.schema_of_variant(usage).startswith("OBJECT"),
        F.struct(
            tier("input_tokens").alias("input"),
            tier("output_tokens").alias("output"),
            tier("cache_read_input_tokens").alias("cache_read"),
            tier("cache_creation_input_tokens").alias("cache_creation"),
        ),
    )
