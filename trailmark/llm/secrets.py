"""Secret scanning: fixed patterns plus a token-efficiency test.

A random string needs about as many vocabulary tokens as it has few characters: its characters-per-token ratio is low.
Runs of secret-like characters, or what the fixed patterns' spans leave of them, are taken as ``random`` spans when the
ratio is low, after known digests (hexadecimal of usual digest lengths), UUIDs, numbers, and identifiers such as paths
and dashed words have been excluded.

Defined results: a null or empty text has no spans; equal texts give equal spans; spans are in code points with an
exclusive end, ordered by start and then kind; extra columns are ignored; texts are scanned whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import map_text

# The patterns of the base spans and the order of kinds.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
#: A text can have an ``assign`` span only with one of these in its lower-cased form.  Fixed values.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Of the method.
LEAST = 20  # characters of a run
RATIO = 2.1  # characters per token; prose has 3 to 5, random base64 about 1.5
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
DIGEST = re.compile(r"(?i)(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{48}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})")
UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")


@lru_cache(maxsize=2)
def token_counter(path: str):
    """A function from a string to its number of tokens under a tiktoken rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda s: len(enc.encode_ordinary(s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, taken: list[tuple[int, int, int]], tokens) -> list[tuple[int, int, int]]:
    """(start, kind, end) of low-ratio runs; of a run that touches spans of ``taken`` the parts beside them."""
    found = []
    taken = sorted(taken)
    at, reach = 0, -1  # spans up to ``at`` start before the run; ``reach`` is their furthest end
    for m in RUN.finditer(text):
        a, b = m.span()
        while at < len(taken) and taken[at][0] < a:
            reach = max(reach, taken[at][2])
            at += 1
        first, parts = max(a, reach), []
        while at < len(taken) and taken[at][0] < b:
            parts.append((first, taken[at][0]))
            reach = max(reach, taken[at][2])
            first = max(first, reach)
            at += 1
        parts.append((first, b))
        for x, y in parts:
            if y - x >= LEAST and is_random(text[x:y], tokens):
                found.append((x, 3, y))
    return found


def is_random(s: str, tokens) -> bool:
    """Few characters to a token, and no digest, UUID or identifier."""
    return not (DIGEST.fullmatch(s) or UUID.fullmatch(s) or _plain(s)) and len(s) / tokens(s) < RATIO


def _plain(s: str) -> bool:
    """An identifier: numbers, and words and words with a short number, two or more of them joined by marks; or a number alone."""
    parts = [p for p in re.split(r"[_/+=-]", s) if p]
    if len(parts) < 2:
        return all(map(str.isdigit, parts))
    return all(p.isdigit() or p.isalpha() and (p[1:].islower() or p.isupper() or len(p) == 1) or re.fullmatch(r"[A-Za-z]{2,}[0-9]{1,4}", p) for p in parts)


def secret_scan(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_assign, n_access, n_hex, n_random long, base_sha256, spans string) for every row of ``docs``."""

    def make():
        tokens = token_counter(vocabulary_path)

        def f(texts):
            rows = []
            for text in texts:
                base = base_spans(text)
                more = random_spans(text, base, tokens)
                say = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
                count = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*count, len(more), hashlib.sha256(say(base).encode()).hexdigest(), say(sorted(base + more))))
            return list(zip(*rows, strict=True))

        return f

    counts, says = ("n_assign", "n_access", "n_hex", "n_random"), ("base_sha256", "spans")
    out = StructType([StructField(n, LongType()) for n in counts] + [StructField(n, StringType()) for n in says])
    return map_text(docs.select(id_col, text_col), make, out, pa.schema([(n, pa.int64()) for n in counts] + [(n, pa.string()) for n in says]), text_col)
