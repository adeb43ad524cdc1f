"""Tool-call columns: family, intent key, sanitised arguments, normalised output."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlens import fixed_values as V
from memlens.functions import text as T


def tool_family(tool: Column) -> Column:
    return T.lookup(tool, V.TOOL_FAMILY, F.lit("other"))


def intent_key(summary: Column, tool: Column) -> Column:
    """``family:words`` of a call: envelope, regex signs, quotes, dashes and flag words removed."""
    inner = F.regexp_extract(summary, r"(?s)^[A-Za-z][A-Za-z0-9]*\((.*)\)\s*$", 1)
    s = F.when(summary.rlike(r"(?s)^[A-Za-z][A-Za-z0-9]*\(.*\)\s*$"), inner).otherwise(summary)
    s = F.regexp_replace(F.lower(s), r"""[*?\[\]()\\^$+|.{}/#'"`_\-\s]+""", " ")
    kept = F.filter(F.split(F.trim(s), " "), lambda t: (t != "") & ~t.isin(V.INTENT_FLAG_WORDS))
    return F.rtrim(F.concat(tool_family(tool), F.lit(":"), F.array_join(kept, " ")))


def hmac_sha256(salt: str, message: Column) -> Column:
    """HMAC with a constant key: the two padded keys are literals, both hashes run in the JVM."""
    key = salt.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


def sanitize_args(tool: Column, path: Column, pattern: Column, command: Column, base: str, salt: str) -> Column:
    """Struct(arg_summary, arg_key): allow-listed fields only, hidden when anything looks unsafe."""
    unleaked = lambda value: T.let(value, lambda v: F.when(T.leakage(v, core=False).isNull(), v))
    flat = F.substring(F.trim(F.regexp_replace(F.coalesce(pattern, F.lit("")), r"[\r\n\t]", " ")), 1, V.PATTERN_CLIP)
    first = F.regexp_extract(F.coalesce(command, F.lit("")), r"^\s*([^\s|&;]*)", 1)
    cmd = F.element_at(F.split(F.regexp_replace(first, "^[./~]+", ""), r"[\\/]"), -1)
    parts = F.struct(unleaked(T.repo_relative(path, base)).alias("rel"), unleaked(F.nullif(flat, F.lit(""))).alias("pat"),
                     unleaked(F.when(F.length(cmd).between(1, 64), cmd)).alias("cmd"))
    searching = tool.isin("Grep", "Glob")
    quoted = F.concat(F.lit('"'), F.regexp_replace(tool, r'(["\\])', r'\\$1'), F.lit('"'))

    def shown(p: Column) -> Column:
        located = F.concat(tool, F.lit('("'), p["pat"], F.lit('")'), F.coalesce(F.concat(F.lit("["), p["rel"], F.lit("]")), F.lit("")))
        return (F.when(tool == "Read", F.concat(F.lit("Read("), p["rel"], F.lit(")")))
                .when(searching, located).when(tool == "Bash", F.concat(F.lit("Bash("), p["cmd"], F.lit(")"))))

    def built(p: Column, summary: Column) -> Column:
        # Field names inside one call are already in sorted order; nulls are left out of the JSON.
        args = (F.when(summary.isNull(), F.lit('{"hidden":true}'))
                .when(tool == "Read", F.to_json(F.struct(p["rel"].alias("file_path"))))
                .when(searching, F.to_json(F.struct(p["rel"].alias("path"), p["pat"].alias("pattern"))))
                .otherwise(F.to_json(F.struct(p["cmd"].alias("command")))))
        message = F.concat(F.lit('{"args":'), args, F.lit(',"tool":'), quoted, F.lit("}"))
        return F.struct(F.coalesce(summary, F.concat(tool, F.lit(f"({V.HIDDEN_ARG})"))).alias("arg_summary"),
                        F.substring(hmac_sha256(salt, message), 1, V.ARG_KEY_HEX).alias("arg_key"))

    return T.let(parts, lambda p: T.let(unleaked(shown(p)), lambda summary: built(p, summary)))


_ESCAPES = "|".join([
    "\\x1b\\][^\\x07]*\\x07", "\\x1b\\](?s:.*?)\\x1b\\\\", "\\x1b\\[[\\x30-\\x3f]*[\\x20-\\x2f]*[\\x40-\\x7e]",
    "\\x{9b}[\\x30-\\x3f]*[\\x20-\\x2f]*[\\x40-\\x7e]", "\\x1b[\\x20-\\x2f][\\x30-\\x7e]", "\\x1b[\\x30-\\x7f]"])


def strip_escapes(text: Column) -> Column:
    """Terminal escape sequences removed: OSC, CSI, two-byte and single-final-byte forms."""
    for part in _ESCAPES.split("|"):
        text = F.regexp_replace(text, part, "")
    return text


def normalize_output(text: Column, tool_name: str = "memlens") -> Column:
    """Escapes stripped, adjacent equal lines folded with a count marker, cut at 4096 characters.

    Runs are found from the positions where a line differs from the one before,
    so the work is linear in the number of lines.
    """
    lines = F.split(F.regexp_replace(strip_escapes(text), "\r\n", "\n"), "\n")
    return T.let(T.let(lines, lambda ls: _fold_runs(ls, tool_name)), lambda full: _cut_output(full, tool_name))


def _fold_runs(lines: Column, tool_name: str) -> Column:
    before = F.concat(F.array(F.lit(None).cast("string")), lines)
    changed = F.zip_with(lines, before, lambda a, b: ~a.eqNullSafe(b))
    starts = F.filter(F.transform(changed, lambda c, i: F.when(c, i + 1)), lambda i: i.isNotNull())
    # The shifted array is one longer, so its last pair always counts as a change: the end mark.
    def rows(st: Column) -> Column:
        spans = F.zip_with(F.slice(st, 1, F.size(st) - 1), F.slice(st, 2, F.size(st)), lambda s, e: F.struct(s.alias("s"), (e - s).alias("n")))
        note = lambda n: F.concat(F.lit("... [repeated "), (n - 1).cast("string"), F.lit(f" lines by {tool_name}]"))
        return F.flatten(F.transform(spans, lambda x: F.when(
            x["n"] > 1, F.array(F.element_at(lines, x["s"]), note(x["n"]))).otherwise(F.array(F.element_at(lines, x["s"])))))
    return F.array_join(T.let(starts, rows), "\n")


def _cut_output(full: Column, tool_name: str) -> Column:
    kept = F.substring(full, 1, V.TOOL_OUTPUT_CHARS)
    dropped = F.size(F.split(full, "\n")) - F.size(F.split(kept, "\n"))
    note = F.when(dropped > 0, F.concat(F.lit("\n... ["), dropped.cast("string"), F.lit(f" lines truncated by {tool_name}]"))).otherwise(
        F.concat(F.lit(f"\n... [truncated by {tool_name}: "), (F.length(full) - V.TOOL_OUTPUT_CHARS).cast("string"), F.lit(" chars omitted]")))
    return F.when(F.length(full) <= V.TOOL_OUTPUT_CHARS, full).otherwise(F.concat(kept, note))
