"""Secrets in texts: fixed patterns, and literals that source or configuration assigns to sensitive names.

Assignments of any common syntax (``name = "x"``, ``name: x``, ``"name": "x"``,
``name := x``, ``name => x``, ``obj["name"] = x``, ``name: str = "x"``,
``--name x``, ``<name>x</name>``) are lexed into pairs of a target name and
literals or references.  References are followed to the constants that they
name (``KEY = "x"`` ... ``password = KEY``, ``${KEY}``), and every literal is
scored by the most sensitive name that it reaches and by its own looks.

All work on a text is linear in its length and local to its row; texts without
a word that a sensitive name could be made of are not lexed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import table, tidy

# Fixed values of the contract: base patterns, their order and least lengths.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # shorter runs fail, and a run has no second beginning
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Words of target names and what they weigh.
WEIGHTS = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "secrets": 3, "credential": 3, "credentials": 3, "apikey": 3, "token": 2, "pass": 2, "passcode": 2,
    "auth": 1, "bearer": 1, "salt": 1, "pin": 1, "otp": 1,
}
KEY_OF = ("api", "access", "private", "signing", "encryption", "master", "session", "ssh", "shared", "service", "account", "client", "hmac", "deploy", "license")
KEY_WEIGHT = 3  # "key" after one of these
CALMING = ("count", "counts", "len", "length", "limit", "max", "min", "size", "type", "name", "url", "uri", "path", "file", "dir", "field", "column", "label", "hint", "policy", "expiry", "expires", "ttl", "timeout", "format", "prefix", "pattern", "regex", "enabled", "required", "header", "param", "placeholder", "input", "reset", "id")
CALM = -3
STEMS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "salt", "pin", "otp")
THRESHOLD = 4

PLACEHOLDER = re.compile(r"(?i)\A(?:null|none|nil|true|false|undefined|todo|tbd|n/?a|(?:your|my|some|an?|the)[-_ ].*|.*(?:change[-_ ]?me|example|placeholder|redacted|dummy).*|(.)\1*|x{3}.*|\*+.*)\Z", re.DOTALL)
TEMPLATE = re.compile(r"\$\{|\{\{|<[^>]*>|%\(|\$\(|\A\$\w+\Z|\A%\w+%\Z|\A\{\w*\}\Z")
OPERATOR = re.compile(r"(?<![=!<>:+*/%&|^~-])(?::=|=>|=(?![=>~])|:(?![:=/]))|(?<=[A-Za-z_])\?=")
FLAG = re.compile(r"(?<!\S)--([A-Za-z][\w-]*)\x20+(?=[^\s-])")
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)>([^<>\n]+)</")
NAME_CHARS = re.compile(r"[\w.$-]")
ANNOTATION = re.compile(r"[ \t]*[A-Za-z_][\w.]*(?:\[[\w.,| ]*\])?(?:[ \t]*\|[ \t]*\w+)?[ \t]*=(?![=>])")
REFERENCE = re.compile(r"(?:\$\{?([A-Za-z_]\w*)\}?|%([A-Za-z_]\w*)%|\*?([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*))")
BARE = re.compile(r"[^\s,;()\[\]{}\"'`<>=&]+(?:={1,2}(?=[\s,;]|\Z))?")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
LOOKED_UP = ("getenv", "get", "env", "environ", "lookup", "fetch")  # calls whose first argument is a name, not a value


@dataclass(frozen=True)
class Pair:
    """A target name with the literals (start, end, quoted) or the references that it is given, at a place of the text."""

    at: int
    name: str
    literals: tuple[tuple[int, int, bool], ...]
    references: tuple[str, ...]


def _name_before(text: str, at: int, floor: int) -> str:
    """The target of the operator at ``at``: a word, a quoted key, or the last key of subscripts."""
    end = at
    while end > floor and text[end - 1] in " \t":
        end -= 1
    if end > floor and text[end - 1] == "]":
        end -= 1
        while end > floor and text[end - 1] in " \t\"'`":
            end -= 1
    elif end > floor and text[end - 1] in "\"'`":
        end -= 1
    start = end
    while start > floor and NAME_CHARS.match(text, start - 1):
        start -= 1
    return text[start:end]


def _string(text: str, at: int) -> tuple[int, int, int] | None:
    """Start, end and what follows of the string literal whose quote is at ``at``; None if it does not close."""
    quote = text[at]
    if text.startswith(quote * 3, at):
        end = text.find(quote * 3, at + 3)
        return (at + 3, end, end + 3) if end >= 0 else None
    end = at + 1
    while end < len(text) and text[end] != quote:
        if text[end] == "\n" and quote != "`":
            return None
        end += 2 if text[end] == "\\" else 1
    return (at + 1, end, end + 1) if end < len(text) else None


def _skip(text: str, at: int, blank: str = " \t") -> int:
    while at < len(text) and text[at] in blank:
        at += 1
    return at


def _value(text: str, at: int) -> tuple[list[tuple[int, int, bool]], list[str], int]:
    """Literals and references from ``at`` on, and where they end: strings joined by ``+`` or next to each other, a call's
    string arguments, a reference, or a bare word as configuration has it."""
    literals: list[tuple[int, int, bool]] = []
    references: list[str] = []
    at = _skip(text, at)
    while at < len(text):
        prefixed = at + 1 if text[at] in "rbufRBUF@" and at + 1 < len(text) and text[at + 1] in "\"'" else at
        if text[prefixed] in "\"'`":
            found = _string(text, prefixed)
            if found is None:
                break
            start, end, at = found
            whole = REFERENCE.fullmatch(text, start, end) if text[start:end].startswith(("$", "%")) else None
            references.append(whole[1] or whole[2]) if whole and (whole[1] or whole[2]) else literals.append((start, end, True))
        else:
            word = REFERENCE.match(text, at)
            bare = BARE.match(text, at)
            if bare is None:
                break
            if word and word[3] and text.startswith("(", word.end()):
                at = word.end() + 1
                named = word[3].rpartition(".")[2].lower() in LOOKED_UP
                while at < len(text) and text[at] not in ")\n":
                    if text[at] in "\"'":
                        found = _string(text, at)
                        if found is None:
                            return literals, references, at + 1
                        if not named:
                            literals.append((found[0], found[1], True))
                        named, at = False, found[2]
                    else:
                        at += 1
                return literals, references, at
            if word and word.end() == bare.end():
                references.append(word[1] or word[2] or word[3])
            start, at = bare.span()
            while at > start and text[at - 1] in ".:!?":
                at -= 1
            if at > start:
                literals.append((start, at, False))
        then = _skip(text, at)
        if text.startswith("+", then):
            at = _skip(text, then + 1, " \t\n\\")
        elif literals and literals[-1][2] and then < len(text) and text[then] in "\"'":
            at = then
        else:
            break
    return literals, references, at


def pairs(text: str) -> list[Pair]:
    """The assignments of a text, by place."""
    found, at, floor = [], 0, 0
    while (m := OPERATOR.search(text, at)) is not None:
        name = _name_before(text, m.start(), floor)
        at = floor = m.end()
        if not name:
            continue
        if m[0] == ":" and (typed := ANNOTATION.match(text, at)) is not None:
            at = typed.end()
        literals, references, at = _value(text, at)
        if literals or references:
            found.append(Pair(m.start(), name, tuple(literals), tuple(references)))
        if literals and literals[-1][2]:
            floor = at  # what is in quotes is no target; a bare value may be the next one's
    for pattern in (FLAG, ELEMENT):
        for m in pattern.finditer(text):
            if pattern is ELEMENT:
                literals, references = [(m.start(2), m.end(2), False)], []
            else:
                literals, references, _ = _value(text, m.end())
            if literals or references:
                found.append(Pair(m.start(), m[1], tuple(literals), tuple(references)))
    return sorted(found, key=lambda p: p.at)


def name_score(name: str) -> int:
    """How sensitive a target name is, by its words (camel, snake, kebab and dotted)."""
    words = [w.lower() for w in WORDS.findall(name)]
    score = max((WEIGHTS.get(w, 0) for w in words), default=0)
    for before, word in zip(words, words[1:], strict=False):
        if word == "key" and before in KEY_OF or before + word == "apikey":
            score = max(score, KEY_WEIGHT)
    if score and words[-1] in CALMING or any(w in ("max", "min") for w in words):
        score += CALM
    return score


def literal_score(value: str, quoted: bool) -> float:
    """How much a literal looks like a secret; placeholders, templates and prose never do."""
    from math import log2

    if len(value) < 6 or PLACEHOLDER.match(value) or TEMPLATE.search(value) or value.count(" ") > 2 or "\n" in value.strip():
        return float("-inf")
    size = len(value)
    bits = -sum(n / size * log2(n / size) for n in map(value.count, set(value)))
    letters = any(c.isalpha() for c in value)
    digits = any(c.isdigit() for c in value)
    plain = value.isalpha() and (value.islower() or value.istitle() or value.isupper())
    return (size >= 8) + (size >= 16) + (letters and digits) + (bits >= 3) + quoted - plain * (1 if quoted else 2)


def assigned_secrets(text: str) -> list[tuple[int, int, str, float]]:
    """Start, end, target name and score of the literals that reach a sensitive name.

    A reference means the last definition of the name before it, else the
    first one after it; rings of references end."""
    found = pairs(text)
    places: dict[str, list[int]] = {}
    for i, pair in enumerate(found):
        for key in {pair.name, pair.name.rpartition(".")[2]}:
            places.setdefault(key, []).append(i)

    def definition(name: str, i: int) -> int | None:
        own = places.get(name) or places.get(name.rpartition(".")[2])
        if not own:
            return None
        k = bisect_left(own, i)
        return own[k - 1] if k else next((x for x in own if x > i), None)

    # sensitivity flows from a target to the definitions that it refers to
    best = [name_score(p.name) for p in found]
    by = [p.name for p in found]
    todo = sorted(range(len(found)), key=lambda i: best[i])
    while todo:
        i = todo.pop()
        for name in found[i].references if best[i] > 0 else ():
            k = definition(name, i)
            if k is not None and best[k] < best[i]:
                best[k], by[k] = best[i], by[i]
                todo.append(k)
    out: dict[tuple[int, int], tuple[str, float]] = {}
    for i, pair in enumerate(found):
        if best[i] <= 0:
            continue
        known = {x for x in pair.references if definition(x, i) is not None}
        for start, end, quoted in pair.literals:
            value = text[start:end]
            score = best[i] + literal_score(value, quoted)
            if score >= THRESHOLD and value not in known and score > out.get((start, end), ("", 0))[1]:
                out[start, end] = by[i], score
    return [(start, end, name, float(score)) for (start, end), (name, score) in sorted(out.items())]


def _maybe_hex(text: str) -> bool:
    """False only if no run of 32 hex digits is in the text: such a run holds eight of every fourth character."""
    return b"\1" * (HEX_LEAST // 4) in text.encode("latin-1", "replace")[3::4].translate(_IS_HEX)


_IS_HEX = bytes(chr(i) in "0123456789abcdef" for i in range(256))


def spans_of(text: str) -> list[tuple[str, int, int, str | None, float | None]]:
    """kind, start, end (in code points, exclusive), and for literals the target's name and score; by start, then kind."""
    out: list[tuple[str, int, int, str | None, float | None]] = []
    lower = text.lower()
    operator = "=" in text or ":" in text
    if operator and any(w in lower for w in ASSIGN_WORDS):
        out += [("assign", *m.span(), None, None) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", *m.span(), None, None) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if _maybe_hex(text):
        out += [("hex", *m.span(), None, None) for m in HEX.finditer(text)]
    if (operator or "--" in text or "</" in text) and any(w in lower for w in STEMS):
        out += [("literal", *x) for x in assigned_secrets(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def secret_spans(documents: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, name, score) of every row, an empty array for none.

    A null text counts as empty; a null doc_id, repeated rows and very long
    texts are scanned like others; other columns are not read; an empty table
    gives an empty result.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found = [[dict(zip(("kind", "start", "end", "name", "score"), x, strict=True)) for x in spans_of(t.as_py() or "")] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    return documents.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,name:string,score:double>>")


def mask(text: str) -> str:
    """The text with every found span replaced by ``[secret]``, overlapping ones together."""
    parts, at = [], 0
    for _, start, end, _, _ in spans_of(text):
        if start > at or not parts:
            parts += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def masked(documents: DataFrame) -> DataFrame:
    """``documents`` with their texts masked, n_chars (where there is such a column) to match; a null text stays null."""
    @F.pandas_udf("string")
    def masking(texts: pd.Series) -> pd.Series:
        return texts.map(mask, na_action="ignore")

    rows = documents.withColumn("text", masking(F.col("text")))
    return rows.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in documents.columns else rows


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_spans(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = _joined(F.filter("spans", lambda x: x["kind"] != "literal"))
    return rows.select("doc_id", *map(count, KINDS[:3]), F.sha2(base.cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
