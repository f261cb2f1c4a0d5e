"""The programs that a shell line runs, as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Heads that run the command after them (fixed values).
TRANSPARENT = ("sudo", "command", "time", "env", "nohup", "xargs", "nice", "exec")
_QUOTED = "\x01"


def invoked_commands(line: Column) -> Column:
    """Program names in order. The bodies of here-documents go, quoted text is one opaque word, operators part commands, and wrappers and assignments are passed over."""
    # The lines between `<< word` and a line that is the word belong to the command's input.
    x = F.regexp_replace(line, "(?s)(<<-?[ \\t]*+[\"']?([A-Za-z0-9_]++)[\"']?[^\\n]*+)\\n(?:(?![ \\t]*\\2[ \\t]*(?:\\n|\\z))[^\\n]*+\\n)*+[ \\t]*\\2[ \\t]*(?=\\n|\\z)", "$1")
    x = F.regexp_replace(x, "'[^']*'?|\"[^\"]*\"?", _QUOTED)
    segments = F.transform(F.split(x, r"&&|\|\||[;|\n&]"), lambda s: F.split(F.regexp_replace(s, r"^[\s({!]+", ""), r"\s+"))
    passed = lambda w: (w == "") | w.rlike("^[A-Za-z_][A-Za-z0-9_]*=") | w.isin(*TRANSPARENT)
    heads = F.transform(segments, lambda ws: F.substring_index(F.get(F.filter(ws, lambda w: ~passed(w)), F.lit(0)), "/", -1))
    return F.coalesce(F.filter(heads, lambda h: h.isNotNull() & (h != "") & ~h.contains(_QUOTED)), F.array().cast("array<string>"))
