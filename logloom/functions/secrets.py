"""Masking of secrets as columns: each rule is one regular expression over the whole text, and rows stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Last words of names that hold a secret (fixed values).
SECRET_WORDS = tuple(
    "key keys token tokens secret secrets password passwords passwd pwd pass passphrase passphrases credential credentials "
    "creds authorization auth bearer cookie cookies signature signatures jwt pat apikey apisecret apitoken accesskey "
    "accesstoken authtoken bearertoken clientsecret privatekey refreshtoken secretkey sessionkey session sessions".split()
)
MASK = "[redacted]"

# A word of a name begins at a separator or where case rises; numbers may follow the last one.
_LAST = r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:" + "|".join(SECRET_WORDS) + r")[0-9]*+"
_NAME = rf"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]*{_LAST}(?![A-Za-z0-9_.-])"
_MASKED = r"\[redacted\]"
#: (pattern, replacement) in order: variables that name a secret, passwords in addresses, bearers, and what is assigned to a secret's name.
RULES = (
    (rf"\$\{{[A-Za-z0-9_]*{_LAST}(?![A-Za-z0-9_])[^{{}}\n]*\}}", MASK),
    (rf"\$[A-Za-z0-9_]*{_LAST}(?![A-Za-z0-9_])", MASK),
    (rf"(://[^\s/?#@:]*:)(?!{_MASKED}@)[^\s/?#]+(?=@)", f"$1{MASK}"),
    (rf"(?i)\b(bearer[ \t]+)(?!{_MASKED})[^\s\"'`,;]+", f"$1{MASK}"),
    (rf"(?i)(authorization[\"'`]?[ \t]*[:=][ \t]*[\"'`]?basic[ \t]+)(?!{_MASKED})[^\s\"'`,;]+", f"$1{MASK}"),
    (rf"({_NAME}[\"'`]?[ \t]*[=:](?![=:])[ \t]*[\"'`]?)(?!{_MASKED}|\$|(?i:bearer|basic)\b)[^\s\"'`,;&(){{}}\[\]#]+", f"$1{MASK}"),
)


def _masks(text: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(MASK), F.lit("")))) / len(MASK)).cast("int")


def is_secret_name(name: Column) -> Column:
    return name.rlike(rf"^[^\n]*?{_LAST}$")


def masked(text: Column) -> Column:
    """The text with its secrets masked. Masking it again changes nothing."""
    for pattern, into in RULES:
        text = F.regexp_replace(text, pattern, into)
    return text


def redacted(text: Column) -> Column:
    """struct(text, n_redacted): the masked text, and how many values were masked (0 for null)."""
    out = masked(text)
    return F.struct(out.alias("text"), F.coalesce(_masks(out) - _masks(text), F.lit(0)).alias("n_redacted"))


def _random(run: Column) -> Column:
    """Letters and digits mixed, of many kinds; no hex digest."""
    kinds = F.size(F.array_distinct(F.split(run, "")))
    hex_ = (F.length(run) >= 32) & F.lower(run).rlike("^[0-9a-f]*$")
    return (F.length(run) >= 16) & run.rlike("[0-9]") & run.rlike("[A-Za-z]") & (kinds >= 9) & ~hex_


def masked_command(command: Column) -> Column:
    """A command as it may be shown: without quotes, with the values of secret flags, headers and assignments, and random-looking runs, masked."""
    x = F.regexp_replace(command, rf"((?:-H|--header)[ \t=]+)([\"'])({_NAME}[ \t]*:[ \t]*)(?!{_MASKED})[^\"'\n]*\2", f"$1$2$3{MASK}$2")
    x = F.btrim(F.regexp_replace(F.regexp_replace(x, "[\"']", ""), r"\s+", " "))
    flag = rf"(?<!\S)(-{{1,2}}[A-Za-z0-9_.-]*{_LAST}[ =])(?!--[a-z][a-z0-9-]*(?:\s|$)|-[A-Za-z](?:\s|$)|{_MASKED})\S+"
    x = masked(F.regexp_replace(x, flag, f"$1{MASK}"))
    runs = F.split(x, r"(?<![A-Za-z0-9])(?=[A-Za-z0-9]{16})|(?<=[A-Za-z0-9]{16})(?![A-Za-z0-9])")
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[A-Za-z0-9]+$") & _random(r), MASK).otherwise(r)), "")
