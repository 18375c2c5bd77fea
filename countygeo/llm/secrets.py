"""Secrets in texts: known shapes, and random strings by token efficiency (operator 1)."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countygeo.llm.text import blocks, free_name

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "random")
BASE_KINDS = KINDS[:3]
# Shortest value of an assignment, access key, run of hex digits and random string.
ASSIGN, ACCESS, HEX, RANDOM = 12, 18, 16, 20
# A part is random if a token holds fewer characters on average (prose has about four): with digits, with
# letters of both cases only, with letters of one case only.
RATIO, CASED_RATIO, LETTERS_RATIO = 2.1, 1.9, 1.9
# Shortest part that can be random, and shortest of letters of one case, which must hold DISTINCT of them.
PART, LETTERS, DISTINCT = 8, 20, 8
# Least share of letters in a part with digits; less are dates, times and serial numbers.
LEAST_LETTERS = 0.2
# Tokens are counted in pieces of this many characters, so that the time grows with the length only.
SLICE = 256
# Digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api"))
_KEYWORD = f"(?:{_NAMES.replace(_either_case('api'), _either_case('api') + '_?' + _either_case('key'))})"
_VALUE = "[A-Za-z0-9+/_.=-]"
_MIDDLE = "[\"']?\\x20*[:=]\\x20*[\"']?"
PATTERNS = {
    "assign": re.compile(f"{_KEYWORD}{_MIDDLE}({_VALUE}+)"),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile(f"[0-9a-f]{{{HEX},}}"),
    "random": re.compile(f"[A-Za-z0-9+/_=-]{{{RANDOM},}}"),
}
# Linear-time tests that a text must pass before it is searched for the kind.
_TESTS = {
    "assign": f"{_KEYWORD}{_MIDDLE}{_VALUE}{{{ASSIGN}}}",
    "access": f"AKIA[A-Z0-9]{{{ACCESS - 4}}}",
    "hex": f"[0-9a-f]{{{HEX}}}",
    "random": f"[A-Za-z0-9+/_=-]{{{RANDOM}}}",
}
_UUID = "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
# A digest in base 64 as integrity attributes write it.
_INTEGRITY = "sha(?:256-[A-Za-z0-9+/]{43}=|384-[A-Za-z0-9+/]{64}|512-[A-Za-z0-9+/]{86}==)"
_KNOWN = re.compile(f"(?<![A-Za-z0-9])(?:{_UUID}|{_INTEGRITY})(?![A-Za-z0-9])")
_ALL_HEX = re.compile("[0-9a-f]+|[0-9A-F]+")
_PART = re.compile("[A-Za-z0-9]+")


@functools.lru_cache(maxsize=1)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _plain(part: str) -> bool:
    """Numbers, digests of known lengths, and words in small, capital or initial capital letters."""
    if part.isdigit() or _ALL_HEX.fullmatch(part) and len(part) in DIGESTS:
        return True
    return part.isalpha() and (part[1:].islower() or part.isupper() or len(part) == 1)


def random_part(part: str, path: str) -> bool:
    """Whether the vocabulary can hardly compress a run of letters and digits that is no digest and no number.

    Words of one case are measured in small letters, which the vocabulary knows best.
    """
    letters = sum(map(str.isalpha, part))
    if 2 * sum(ord(b) - ord(a) in (0, 1) for a, b in pairwise(part)) >= len(part):  # alphabets and repeated characters
        return False
    if len(part) < PART or letters < LEAST_LETTERS * len(part) or _ALL_HEX.fullmatch(part) and len(part) in DIGESTS:
        return False
    limit = RATIO if letters < len(part) else CASED_RATIO
    if letters == len(part) and _plain(part):
        part, limit = part.lower(), LETTERS_RATIO
        if len(part) < LETTERS or len(set(part)) < DISTINCT:
            return False
    encoding = _encoding(path)
    tokens = sum(len(encoding.encode_ordinary(part[k:k + SLICE])) for k in range(0, len(part), SLICE))
    return len(part) < limit * tokens


def random_spans(value: str, path: str) -> list[tuple[int, int]]:
    """(start, end) of the random strings in a run of letters, digits and ``+/_=-``.

    The run is measured part by part, so words of a path hide no key behind
    them. A random part takes in neighbours that are neither words nor numbers,
    since ``+/_-`` may be letters of the key. UUIDs and integrity digests are
    passed over, and so is what stays shorter than RANDOM.
    """
    found, at = [], 0
    for a, b in [*(m.span() for m in _KNOWN.finditer(value)), (len(value), len(value))]:
        start = end = None
        random = False
        for m in [*_PART.finditer(value, at, a), None]:
            hit = m is not None and random_part(m[0], path)
            if m is not None and (hit or not _plain(m[0])):
                start = m.start() if start is None else start
                end, random = m.end(), random or hit
                continue
            if random:
                while end < a and value[end] == "=":
                    end += 1
                if end - start >= RANDOM:
                    found.append((start, end))
            start, random = None, False
        at = b
    return found


def spans_of(text: str, kinds: tuple[str, ...], path: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the secrets in a text, by start, then kind."""
    found = []
    for kind in kinds:
        for m in PATTERNS[kind].finditer(text):
            if kind == "random":
                found += [(m.start() + a, len(BASE_KINDS), m.start() + b) for a, b in random_spans(m[0], path)]
            elif not (kind == "assign" and len(m[1]) < ASSIGN or kind == "access" and len(m[0]) < ACCESS):
                found.append((m.start(), KINDS.index(kind), m.end()))
    keep, reach = [], 0
    for start, kind, end in sorted(found):
        # Base spans of the same start come first, so the farthest end so far decides.
        if kind < len(BASE_KINDS):
            reach = max(reach, end)
        elif end <= reach:
            continue
        keep.append((start, KINDS[kind], end))
    return keep


def _kinds_by_row(texts: pa.Array) -> list[tuple[str, ...]]:
    hits = {k: pc.match_substring_regex(texts, t).to_pylist() for k, t in _TESTS.items()}
    return [tuple(k for k in KINDS if hits[k][i]) for i in range(len(texts))]


def _find(path: str):
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            texts = pc.fill_null(batch.column("text"), "")
            rows = []
            for i, kinds in enumerate(_kinds_by_row(texts)):
                text = texts[i].as_py() if kinds else ""
                rows.append([{"kind": k, "start": a, "end": b, "value": text[a:b]} for a, k, b in spans_of(text, kinds, path)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(kind))], ["doc_id", "secrets"])

    return run


def find_secrets(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and secrets (kind, start, end, value; code points, end exclusive) of every row, from its whole text.

    Kinds: ``assign``, ``access`` and ``hex`` by pattern; ``random`` for strings
    (``random_spans``) that the byte-pair vocabulary at ``path`` can hardly
    compress, unless inside one of the others. Null and empty texts have none;
    an empty table gives no rows. A text of any length is searched whole, in
    time that grows with its length. Kinds that start together keep the order
    of KINDS. Each repeated row has its own result; columns of other names are
    ignored.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_find(path or vocabulary_path()),
                           f"doc_id {kind}, secrets array<struct<kind:string,start:bigint,end:bigint,value:string>>")


def listed(secrets: Column) -> Column:
    """kind:start:end of each secret, comma-joined in their order."""
    return F.concat_ws(",", F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact_text(text: str, path: str, mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans_of(text, KINDS, path):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _redact(text: str, path: str, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            texts = batch.column(text)
            kinds = _kinds_by_row(pc.fill_null(texts, ""))
            found = [k for k, some in enumerate(kinds) if some]
            if found:
                clean = pa.array([redact_text(texts[k].as_py(), path, mark) for k in found], texts.type)
                hit = np.zeros(len(texts), dtype=bool)
                hit[found] = True
                texts = pc.replace_with_mask(texts, pa.array(hit), clean)
            yield pa.RecordBatch.from_arrays(
                [texts if c == text else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return run


def redact(documents: DataFrame, text: str = "text", n_chars: str | None = None, path: str | None = None, mark: str = "<SECRET>") -> DataFrame:
    """The documents with every secret replaced by ``mark``; ``n_chars`` follows where the text changed. Null texts stay null.

    Texts are searched in blocks, and only those with a secret leave Arrow.
    Overlapping secrets become one mark for each that begins behind the last.
    Rows, their order within a task, and all other columns stay; an empty table
    stays empty.
    """
    before = free_name(documents, "before")
    if n_chars:
        documents = documents.withColumn(before, F.xxhash64(text))
    out = documents.mapInArrow(_redact(text, path or vocabulary_path(), mark), documents.schema)
    if n_chars:
        kind = documents.schema[n_chars].dataType
        changed = F.xxhash64(text) != F.col(before)
        out = out.withColumn(n_chars, F.when(changed, F.length(text).cast(kind)).otherwise(F.col(n_chars))).drop(before)
    return out
