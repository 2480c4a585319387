"""Payloads and tool calls to text spans."""

from __future__ import annotations

import contextlib
import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnhelm.functions.crypto import base32_prefix, hmac_hex
from tarnhelm.functions.text import bind, running_sums
from tarnhelm.sources.stored import keep

# Nesting rules of JSON kept inside JSON strings.
NESTED_MIN = 8
NESTED_MARK = "$json"

# Keys that decide the origin of what lies below them.
ROOT_ORIGINS = {
    "tools": "tool_definition", "tool_choice": "tool_definition",
    "functions": "tool_definition", "system": "system", "instructions": "system",
}
TOOL_RESULT_KEYS = ("tool_result", "tool_use", "toolResult", "output", "function_call_output")
TOOL_CALL_KEYS = ("tool_calls", "tool_call", "function_call", "arguments")
METADATA_KEYS = (
    "role", "type", "id", "model", "object", "created", "status", "index", "cache_control",
    "anthropic_version", "stop_reason", "finish_reason", "usage", "service_tier",
    "previous_response_id", "schema", "format", "prompt_cache_key", "prompt_cache_options",
    "prompt_cache_retention", "prompt_cache_breakpoint",
)
ROLE_ORIGINS = {
    "system": "system", "developer": "system", "user": "user", "assistant": "assistant",
    "tool": "tool_result", "function": "tool_result",
}

SPAN_SCHEMA = (
    "span_path string, text string, parent_path string, parent_char_offset int, "
    "malformed boolean"
)

#: Levels that are opened in one plan, before strings are looked into and after: deeper documents
#: take further rounds.
LEVELS = (6, 4)

_LITERAL = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_NESTED_START = r"\A[ \t\n\r]*+[{\[]"
_TAG = r"\A(\d+):"


def _tagged(text: Column) -> Column:
    """JSON text whose strings, keys too, begin with their own place in it: ``"17:value"``.

    Parsing forgets where a value stood and refuses an object that repeats a key; in tagged text
    every string carries its place and no two keys are equal.
    """
    literals = F.regexp_extract_all(text, F.lit(_LITERAL), F.lit(0))
    gaps = F.split(text, _LITERAL, -1)

    def glued(z):
        ends = running_sums(F.transform(
            F.arrays_zip(z["gap"].alias("g"), z["lit"].alias("l")),
            lambda x: F.length(x["g"]) + F.coalesce(F.length(x["l"]), F.lit(0))))
        return bind(ends, lambda e: F.array_join(F.transform(z["gap"], lambda g, i: F.concat(
            g, F.when(i < F.size(z["lit"]), F.concat(
                F.lit('"'), F.get(e, i) - F.length(F.get(z["lit"], i)) + 1, F.lit(":"),
                F.substring(F.get(z["lit"], i), F.lit(2), F.length(F.get(z["lit"], i))),
            )).otherwise(""))), ""))

    return bind(F.struct(gaps.alias("gap"), literals.alias("lit")), glued)


def _parsed(text: Column) -> Column:
    """The text as a variant; null unless it is one JSON document and nothing else.

    Parsing alone does not mind what follows a document. So the text is put in a list before
    its own digest, which is only found where the document ends with the text.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.md5(text), F.lit('"]')))
    return bind(_is(listed, "array<variant>"), lambda a: F.when(
        (F.size(a) == 2) & (F.try_variant_get(F.get(a, 1), "$", "string") == F.md5(text)),
        F.get(a, 0)))


def _is(variant: Column, kind: str) -> Column:
    return F.try_variant_get(variant, "$", kind)


def _role(message: Column, tagged: Column) -> Column:
    """The lower-case ``role`` of a message; an empty string if it has none."""
    entries = F.map_entries(_is(message, "map<string,variant>"))
    value = F.get(F.filter(entries, lambda e: F.when(
        tagged, e["key"].rlike(r"\A\d+:role\z")).otherwise(e["key"] == "role")), F.lit(0))
    text = F.try_variant_get(value["value"], "$", "string")
    text = F.when(tagged, F.regexp_replace(text, _TAG, "")).otherwise(text)
    return F.coalesce(F.lower(text), F.lit(""))


_COLUMNS = {
    "path": "string", "value": "variant", "role": "string", "parent": "string",
    "tagged": "boolean", "text": "string", "place": "int", "whole": "boolean",
}
_STATE = f"array<struct<{','.join(f'{c}:{t}' for c, t in _COLUMNS.items())}>>"


def _child(row: Column, **changed) -> Column:
    return F.struct(*[changed.get(c, row[c]).alias(c) for c in _COLUMNS])


def _opened(row: Column) -> Column:
    """What a row becomes: the members of a container, or the text of a string.

    Numbers, true, false and null become nothing. A row with text stays as it is.
    """
    path, value, tagged = row["path"], row["value"], row["tagged"]

    def element(x, i):
        # A message's role holds for all below it, nested documents included.
        lists = row["parent"].isNull() & path.isin("messages", "input")
        return _child(row, path=F.concat(path, F.lit("["), i, F.lit("]")), value=x,
                      role=F.when(lists, _role(x, tagged)).otherwise(row["role"]))

    def member(e):
        key = F.when(tagged, F.regexp_replace(e["key"], _TAG, "")).otherwise(e["key"])
        dot = F.when((path == "") | path.endswith(NESTED_MARK + "."), "").otherwise(".")
        return _child(row, path=F.concat(path, dot, key), value=e["value"])

    def string(t):
        return _child(
            row, value=F.lit(None).cast("variant"),
            path=F.regexp_replace(path, r"(\$json)\.\z", "$1"),
            text=F.when(tagged, F.regexp_replace(t, _TAG, "")).otherwise(t),
            place=F.when(row["parent"].isNotNull(), F.regexp_extract(t, _TAG, 1).cast("int")))

    return (
        F.when(row["text"].isNotNull(), F.array(row))
        .when(_is(value, "array<variant>").isNotNull(),
              F.transform(_is(value, "array<variant>"), element))
        .when(_is(value, "map<string,variant>").isNotNull(),
              F.transform(F.map_entries(_is(value, "map<string,variant>")), member))
        .when(F.schema_of_variant(value) == "STRING",
              F.transform(F.array(_is(value, "string")), string))
        .otherwise(F.array().cast(_STATE))
    )


def _nested(row: Column) -> Column:
    """A row with text that was not looked at yet, and the document inside the text."""
    text, path = row["text"], row["path"]
    document = F.when(
        (F.length(text) >= NESTED_MIN) & text.rlike(_NESTED_START), _parsed(_tagged(text)))
    leaf = _child(row, whole=F.lit(True))
    child = lambda d: _child(
        row, path=F.concat(path, F.lit(NESTED_MARK + ".")), value=d, parent=path,
        tagged=F.lit(True), text=F.lit(None).cast("string"))
    return F.when(text.isNull() | row["whole"], F.array(row)).otherwise(bind(
        document, lambda d: F.when(d.isNull(), F.array(leaf)).otherwise(
            F.array(leaf, child(d)))))


def flatten_spans(payloads: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """One row per string leaf with its path, origin and parent.

    Bodies are parsed once and opened level by level, then the documents inside their strings,
    without Python or a shuffle. One plan has LEVELS levels. A first pass looks for documents that
    go deeper; only these are stored and opened further, until nothing is left to open.
    Malformed and null payloads give one row with ``status = 'malformed_payload'``.
    """
    keys = list(keys)
    names = [f"_k_{i}" for i in range(len(keys))]
    source = payloads.select(
        *[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], F.col(body).alias("_body"))
    source = source.withColumn("_doc", bind(_parsed(F.col("_body")), lambda v: F.when(
        v.isNotNull(), F.struct(v.alias("value"), F.lit(False).alias("tagged"))).otherwise(
        F.struct(_parsed(_tagged(F.col("_body"))).alias("value"), F.lit(True).alias("tagged")))))
    failed = source.where(F.col("_doc.value").isNull())
    start = {"path": F.lit(""), "value": F.col("_doc.value"), "tagged": F.col("_doc.tagged"),
             "whole": F.lit(False)}
    rows = source.where(F.col("_doc.value").isNotNull()).select(*names, F.struct(*[
        start.get(c, F.lit(None)).cast(t).alias(c) for c, t in _COLUMNS.items()]).alias("_s"))
    state = F.col("_s")
    opened, nested = (F.explode(f(state)).alias("_s") for f in (_opened, _nested))
    finished = state["text"].isNotNull() & state["whole"]
    kept = F.struct(*[
        (F.to_json(state[c]) if t == "variant" else state[c]).alias(c)
        for c, t in _COLUMNS.items()]).alias("_s")
    again = F.struct(*[
        (F.try_parse_json(state[c]) if t == "variant" else state[c]).alias(c)
        for c, t in _COLUMNS.items()]).alias("_s")
    done, more = [], True
    while more:
        for levels in LEVELS:
            for _ in range(levels):
                rows = rows.select(*names, opened)
            rows = rows.select(*names, nested)
        done.append(rows.where(finished).select(*names, state.dropFields("value").alias("_s")))
        left = keep(rows.where(~finished).select(*names, kept))
        more = not left.isEmpty()
        rows = left.select(*names, again)
    out = reduce(DataFrame.unionByName, done).select(
        *[F.col(n).alias(c) for c, n in zip(keys, names, strict=True)],
        state["path"].alias("span_path"), state["text"].alias("text"),
        role_origin(span_origin(state["path"]), state["role"]).alias("origin"),
        state["parent"].alias("parent_path"), state["place"].alias("parent_char_offset"),
        F.lit("ok").alias("status"))
    return out.unionByName(failed.select(
        *[F.col(n).alias(c) for c, n in zip(keys, names, strict=True)],
        *[F.lit(None).cast("string").alias(c) for c in ("span_path", "text", "origin",
                                                        "parent_path")],
        F.lit(None).cast("int").alias("parent_char_offset"),
        F.lit("malformed_payload").alias("status")))


def _spans_of(body: str, prefix: str = "", parent: str | None = None) -> list[tuple]:
    """Spans of one document: parsed by the standard library, its strings tagged with places."""
    out: list[tuple] = []
    literal = re.compile(_LITERAL.replace("(?s)", ""), re.S)
    text = literal.sub(lambda m: f'"{m.start() + 1}:{m[0][1:]}', body)
    todo = [(prefix, json.loads(text, object_pairs_hook=lambda pairs: pairs and _Members(pairs)))]
    while todo:
        path, value = todo.pop()
        if isinstance(value, _Members):
            dot = "" if not path or path.endswith(NESTED_MARK + ".") else "."
            todo += [(f"{path}{dot}{k.split(':', 1)[1]}", v) for k, v in value[::-1]]
        elif isinstance(value, list):
            todo += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(value)))]
        elif isinstance(value, str):
            place, text = value.split(":", 1)
            shown = path[:-1] if path.endswith(NESTED_MARK + ".") else path
            out.append((shown, text, parent, None if parent is None else int(place), False))
            if len(text) >= NESTED_MIN and text.lstrip(" \t\n\r")[:1] in ("{", "["):
                with contextlib.suppress(ValueError, RecursionError):
                    out += _spans_of(text, f"{shown}{NESTED_MARK}.", shown)
    return out


class _Members(list):
    """The members of an object, repeated keys included."""


def flatten_json_udtf():
    """Table function ``flatten_json(body)`` for SQL users (LATERAL join)."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=SPAN_SCHEMA)
    class FlattenJson:
        def eval(self, body: str):
            try:
                yield from _spans_of(body or "")
            except (ValueError, RecursionError):
                yield None, None, None, None, True

    return FlattenJson


def register_flatten(spark: SparkSession, name: str = "flatten_json") -> None:
    spark.udtf.register(name, flatten_json_udtf())


def span_origin(path: Column, root: str = "user") -> Column:
    """Origin from the path: a root key decides for everything below it, otherwise the
    deepest key that means something. Text nested with ``$json`` starts over."""
    roots = F.create_map(*[F.lit(x) for kv in ROOT_ORIGINS.items() for x in kv])

    def one_key(acc, key):
        k = F.regexp_replace(key, r"\[\d+\]", "")
        return (
            F.when(k.isin(*TOOL_RESULT_KEYS), "tool_result")
            .when(k.isin(*TOOL_CALL_KEYS), "tool_call")
            .when(k.isin(*METADATA_KEYS), "metadata")
            .otherwise(acc)
        )

    def one_document(acc, piece):
        head = F.try_element_at(roots, F.regexp_extract(piece, r"^([^.\[]*)", 1))
        return F.coalesce(head, F.aggregate(F.split(piece, r"\."), acc, one_key))

    return F.aggregate(F.split(path, r"\$json\.?"), F.lit(root), one_document)


def apply_roles(path: Column, origin: Column, messages: Column, inputs: Column) -> Column:
    """Origin from the ``role`` beside a span in ``messages[i]`` or ``input[i]``."""
    index = F.regexp_extract(path, r"^(?:messages|input)\[(\d+)\]\.", 1)
    i = F.when(index != "", index.cast("int"))
    role = F.when(path.startswith("messages["), F.get(messages, i)).otherwise(F.get(inputs, i))
    return role_origin(origin, role)


def role_origin(origin: Column, role: Column) -> Column:
    """Origin of a span with the role of the message that it is in."""
    mapped = F.try_element_at(
        F.create_map(*[F.lit(x) for kv in ROLE_ORIGINS.items() for x in kv]), role
    )
    fixed = origin.isin("metadata", "tool_definition", "tool_call", "tool_result")
    return F.when(fixed | mapped.isNull(), origin).otherwise(mapped)


def path_get(body: Column, path: Column | str) -> Column:
    """String at a span path; null when the path is not there."""
    p = F.lit(path) if isinstance(path, str) else path
    return F.try_variant_get(F.try_parse_json(body), F.concat(F.lit("$."), p), "string")


def path_exists(body: Column, path: Column | str) -> Column:
    p = F.lit(path) if isinstance(path, str) else path
    return F.try_variant_get(
        F.try_parse_json(body), F.concat(F.lit("$."), p), "variant"
    ).isNotNull()


# Path segments that are safe to show.
SAFE_SEGMENTS = (
    "messages", "content", "system", "tools", "tool_choice", "tool_calls", "tool_call",
    "tool_result", "tool_use", "input", "output", "arguments", "function", "name", "role",
    "type", "text", "model", "metadata", "id", "prompt", "completion", "choices", "delta",
    "parts", "data", "items", "results", "response", "request", "customer", "user",
    "account", "profile", "record", "details", "address", "employee", "order", "invoice",
    "ticket", "issue", "service", "services", "email", "phone", "pan", "aadhaar", "gstin",
    "ifsc", "value", "values",
)


def safe_path(path: Column, key: bytes) -> Column:
    """Path whose unknown segments are replaced by a stub that is stable per key."""
    parts = F.regexp_extract_all(
        path, F.lit(r"(\$json|\[[^\]]*\]|(?:(?!\$json)[^.\[])+)"), F.lit(0)
    )

    def shown(seg):
        stub = F.concat(F.lit("⟨seg_"), base32_prefix(hmac_hex(key, seg), 3), F.lit("⟩"))
        known = (
            seg.rlike(r"\A\[\d+\]\z") | (seg == NESTED_MARK)
            | F.lower(seg).isin(*SAFE_SEGMENTS)
        )
        return F.when(known, seg).otherwise(stub)

    def join(acc, seg):
        glued = (
            (acc == "") | seg.startswith("[") | (seg == NESTED_MARK)
            | acc.endswith(NESTED_MARK)
        )
        return F.when(glued, F.concat(acc, seg)).otherwise(F.concat(acc, F.lit("."), seg))

    return F.aggregate(F.transform(parts, shown), F.lit(""), join)


# ------------------------------------------------------------------ tool calls

# Argument fields per tool and tools that are not looked at.
TOOL_FIELDS = {
    "Bash": ("command",), "Write": ("content", "file_path"),
    "Edit": ("new_string", "old_string"), "NotebookEdit": ("new_source",),
    "WebFetch": ("url", "prompt"), "WebSearch": ("query",), "apply_patch": ("command",),
}
SKIPPED_TOOLS = ("Read", "Glob", "Grep", "TodoWrite", "Task")


#: Levels of lists and objects in the arguments of an ``mcp__`` tool that are looked into.
ARGUMENT_DEPTH = 4


def strings_in(value: Column, depth: int = ARGUMENT_DEPTH) -> Column:
    """All strings of a variant down to ``depth`` levels; members of objects by their keys."""
    members = F.coalesce(_is(value, "array<variant>"),
                         F.map_values(_is(value, "map<string,variant>")))
    own = F.when(F.schema_of_variant(value) == "STRING", F.array(_is(value, "string")))
    none = F.array().cast("array<string>")
    if not depth:
        return F.coalesce(own, none)
    inner = F.flatten(F.transform(members, lambda x: strings_in(x, depth - 1)))
    return F.coalesce(inner, own, none)


def string_arg(args: Column, name: str) -> Column:
    """An argument that is a string; null if it is missing or anything else."""
    value = F.try_variant_get(args, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", _is(value, "string"))


def string_args(args: Column) -> Column:
    """The arguments that are strings, as a map."""
    return F.transform_values(_is(args, "map<string,variant>"), lambda k, v: F.when(
        F.schema_of_variant(v) == "STRING", _is(v, "string")))


def harvest(tool: Column, args: Column) -> Column:
    """Text of a tool call: named fields per tool, every string for ``mcp__`` tools, in lists
    and objects too.

    ``args`` is a variant that holds an object.
    """
    out = F.when(tool.isin(*SKIPPED_TOOLS), "")
    for name, fields in TOOL_FIELDS.items():
        out = out.when(tool == name, F.concat_ws("\n", *[string_arg(args, f) for f in fields]))
    return out.when(
        tool.startswith("mcp__"), F.array_join(strings_in(args), "\n")).otherwise("")


def _arg(args: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(string_arg(args, n), F.lit("")) for n in names], F.lit(""))


def sink_of(tool: Column, args: Column) -> Column:
    """Where a call writes: a file argument, or the first redirect of a command."""
    redirect = r">>?\s*(\S+)|\btee\s+(?:-a\s+)?(\S+)|(?:^|\s)--?o(?:utput)?[=\s]\s*(\S+)"
    command = _arg(args, "command")
    first = F.coalesce(
        *[F.nullif(F.regexp_extract(command, redirect, i), F.lit("")) for i in (1, 2, 3)],
        F.lit(""),
    )
    return (
        F.when(tool.isin("Write", "Edit", "NotebookEdit"),
               _arg(args, "file_path", "notebook_path"))
        .when(tool == "Bash", first).otherwise("")
    )


def payload_of(tool: Column, args: Column) -> Column:
    """What a call writes: the content field, or the quoted parts of a command."""
    quoted = F.regexp_extract_all(
        _arg(args, "command"), F.lit(r"""('[^']*'|"[^"]*")"""), F.lit(0)
    )
    inner = F.transform(quoted, lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
    kept = F.filter(inner, lambda q: (q != "") & ~q.rlike(r"\A%[a-z]\z"))
    return (
        F.when(tool.isin("Write", "NotebookEdit"), _arg(args, "content", "new_source"))
        .when(tool == "Edit", _arg(args, "new_string"))
        .when(tool == "Bash", F.array_join(kept, "")).otherwise("")
    )


# Reading verbs, path arguments, read tools and binary suffixes.
READERS = (
    "cat", "bat", "head", "tail", "less", "more", "nl", "strings", "xxd", "od", "grep",
    "egrep", "fgrep", "rg", "ag", "ack", "jq", "yq", "column", "tac", "type",
    "get-content", "gc",
)
PATH_KEYS = (
    "file_path", "filepath", "path", "notebook_path", "file", "filename", "target_file",
)
READ_TOOLS = ("Read", "NotebookRead", "Grep")
READ_VERBS = (
    "read", "cat", "open", "fetch", "get_file", "get_document", "load", "view", "search",
    "grep", "find_in",
)
BINARY_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".pdf", ".zip", ".gz", ".tar", ".whl",
    ".exe", ".dll", ".so", ".dylib", ".pyc", ".woff", ".woff2", ".ttf", ".mp4",
)


def _command_targets(command: Column) -> Column:
    """Files a shell command reads: arguments of reading verbs and ``<`` sources."""
    parts = F.filter(
        F.transform(F.split(command, r"&&|\|\||;|\||\n"), F.trim), lambda p: p != ""
    )
    tokens = F.transform(
        parts,
        lambda p: F.regexp_extract_all(
            p, F.lit(r"""((?:"[^"]*"|'[^']*'|[^\s"'])+)"""), F.lit(0)
        ),
    )

    def targets(ts):
        verb = F.lower(
            F.regexp_extract(F.regexp_replace(F.get(ts, F.lit(0)), "[\"']", ""), r"([^/]*)$", 1)
        )
        before = F.concat(F.array(F.lit("")), ts)

        def source(t, i):
            prev = F.get(before, i)
            return F.when(prev == "<", t).when(
                t.startswith("<") & ~t.startswith("<<") & (F.length(t) > 1),
                F.substring(t, F.lit(2), F.length(t)),
            )

        def argument(t, i):
            prev = F.get(before, i)
            skip = (
                (i == 0) | prev.isin(">", ">>", "1>", "2>", "&>")
                | t.isin(">", ">>", "1>", "2>", "&>", "|", "<")
                | t.startswith(">") | t.startswith("-")
            )
            return F.when(verb.isin(*READERS) & ~skip, t)

        found = F.concat(F.transform(ts, source), F.transform(ts, argument))
        return F.filter(found, lambda t: t.isNotNull())

    return F.flatten(F.transform(tokens, targets))


def read_targets(tool: Column, args: Column) -> Column:
    """Distinct files a tool call names for reading, binary suffixes left out."""
    name = F.lower(F.element_at(F.split(tool, "__"), -1))
    reads = tool.isin(*READ_TOOLS) | (
        tool.startswith("mcp__") & name.rlike("|".join(READ_VERBS))
    )
    by_key = F.map_values(
        F.map_filter(string_args(args), lambda k, v: F.lower(k).isin(*PATH_KEYS) & (
            F.trim(v) != ""))
    )
    raw = F.when(tool.isin("Bash", "shell"), _command_targets(_arg(args, "command"))).when(
        reads, by_key
    ).otherwise(F.array().cast("array<string>"))
    clean = F.transform(raw, lambda t: F.trim(F.regexp_replace(t, r"""^["']+|["']+$""", "")))
    binary = "(?i)(?:" + "|".join(re.escape(s) for s in BINARY_SUFFIXES) + r")\z"
    return F.array_distinct(F.filter(clean, lambda t: (t != "") & ~t.rlike(binary)))


def harness_of(explicit: Column, user_agent: Column, route: Column) -> Column:
    """Client label: an explicit header, a known user agent, else the route."""
    given = F.substring(F.nullif(F.lower(F.trim(explicit)), F.lit("")), 1, 80)
    agent = F.lower(F.coalesce(user_agent, F.lit("")))
    return F.coalesce(
        given,
        F.when(F.contains(agent, F.lit("codex")), "codex")
        .when(F.contains(agent, F.lit("cursor")), "cursor")
        .when(F.contains(agent, F.lit("claude")), "claude")
        .when(route == "/v1/responses", "openai-responses-compatible")
        .when(route == "/v1/chat/completions", "openai-chat-compatible")
        .when(route == "/v1/messages", "anthropic-compatible")
        .otherwise("unknown"),
    )
