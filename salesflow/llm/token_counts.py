"""Token counts of whole texts, as a tokenizer library gives them.

Texts over ``CHUNK`` characters are encoded in overlapping chunks with offsets. Two neighbours are spliced where both have the same
two tokens side by side: the same ids at the same places. A byte-pair encoding is the only one of its text whose neighbours
are all valid pairs, and this pair is one as it stands in both, so what is before it in the left chunk and behind it in the
right one together is the encoding of the whole. Pieces between the pre-tokenizer's cuts begin anew at each cut, so the
same holds for them. Where an overlap has no such place it is doubled from its end backwards, at last to the whole chunk.
No white space is needed, so texts in Chinese or Thai cost no more than others.

Shorter texts are cut at ASCII white space, which is never inside a token, and each different piece is encoded once per task. Both
hold for the normaliser and pre-tokenizer this was written for (RULES); with any other tokenizer file every text is encoded
whole. The file is read where the query is made, and its content travels with the tasks.

Null and empty texts have 0 bytes and 0 tokens. Every row of the input gives one row, repeated ids too; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK, OVERLAP = 65_536, 256
CACHED = 1_000_000  # pieces remembered per task, then forgotten; bounds memory only
PIECE_BYTES = 1 << 22
# Digest of the normaliser and pre-tokenizer that the cutting of texts was written for.
RULES = "030f605e4f340b0458c72cba5c104920ded9b7910a25d9e82c455d4a8374b9a5"
# A run of letters with ASCII marks before and after it: the pre-tokenizer always cuts between the three. Without ' (it
# starts 's, 't ...), and without < in front (it starts a special token).
MARKED = re.compile("([!-&(-/:;=-@[-`{-~]*)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@[-`{-~]*)")


def load(content: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(content)
    found.no_truncation()
    found.no_padding()
    return found


def rules_of(content: str) -> str:
    """Digest of how a tokenizer file cuts texts into pieces."""
    held = json.loads(content)
    return hashlib.sha256(json.dumps([held.get("normalizer"), held.get("pre_tokenizer")], sort_keys=True).encode()).hexdigest()


def tokens_of(tokenizer, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """(start, end, id) of the tokens of text[start:end], in places of the whole text."""
    found = tokenizer.encode(text[start:end], add_special_tokens=False)
    return [(a + start, b + start, i) for (a, b), i in zip(found.offsets, found.ids)]


def splice_point(left: list, right: list) -> tuple[int, int] | None:
    """How many tokens of ``left`` and of ``right`` come before the last pair of neighbours that both have, or None.

    The splice is between the two. The last token of the left chunk and the first of the right one may be cut and do not count.
    """
    known = {(right[i], right[i + 1]): i + 1 for i in range(1, len(right) - 1)}
    for i in range(len(left) - 3, -1, -1):
        at = known.get((left[i], left[i + 1]))
        if at is not None and left[i][1] > left[i][0]:
            return i + 1, at
        if left[i][0] < right[0][0]:
            return None
    return None


def spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text`` from overlapping chunks."""
    total, start, end, pair = 0, 0, min(chunk, len(text)), None
    left = tokens_of(tokenizer, text, start, end)
    while end < len(text):
        wide = overlap
        while True:
            low = end - wide
            if low <= start:  # the whole chunk has been tried: both chunks as one, from the last splice on
                end = min(end + max(chunk, end - start), len(text))
                left = tokens_of(tokenizer, text, start, end)
                if pair:
                    at = next((i for i in range(len(left) - 1) if (left[i], left[i + 1]) == pair), None)
                    if at is None:
                        return len(tokens_of(tokenizer, text, 0, len(text)))
                    left = left[at + 1:]
                break
            upto = min(end + chunk, len(text))
            right = tokens_of(tokenizer, text, low, upto)
            found = splice_point(left, right) if right else None
            if found:
                total += found[0]
                pair = (left[found[0] - 1], left[found[0]])
                left, start, end = right[found[1]:], low, upto
                break
            wide *= 2
    return total + len(left)


class Counter:
    def __init__(self, content: str):
        self.tokenizer, self.seen, self.cuts = load(content), {}, rules_of(content) == RULES

    def encode(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 4096):
            part = pieces[at:at + 4096]
            got = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.seen.update(zip(part, map(len, got)))

    def counts(self, texts: list[bytes]) -> list[int]:
        if not self.cuts:
            return [len(e) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        pieces = [t.split() for t in texts]
        if len(self.seen) > CACHED:
            self.seen.clear()
        seen = self.seen
        new = {p: p.decode() for p in set().union(*pieces) if p not in seen}
        cut = {p: (m[1], m[2].lower(), m[3]) for p, t in new.items() if (m := MARKED.fullmatch(t))}
        parts = {"": 0} | dict.fromkeys(x for three in cut.values() for x in three if x) | dict.fromkeys(
            t for p, t in new.items() if p not in cut)
        self.encode([x for x in parts if x and x not in seen])
        seen[""] = 0
        for p, t in new.items():
            seen[p] = sum(seen[x] for x in cut[p]) if p in cut else seen[t]
        return [sum(map(seen.__getitem__, p)) for p in pieces]


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 2048,
                 chunk: int = CHUNK) -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) for each row."""

    with open(path, encoding="utf-8") as file:
        content = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(content)  # the tokenizer file, whatever the rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            sizes, tokens, group, places = [], [], [], []

            def flush():
                for place, n in zip(places, counter.counts(group)):
                    tokens[place] = n
                group.clear()
                places.clear()

            held = 0
            for value in batch.column(1):
                body = value.as_py() or ""
                raw = body.encode()
                sizes.append(len(raw))
                tokens.append(0)
                if len(body) > chunk and counter.cuts:
                    tokens[-1] = spliced(counter.tokenizer, body, chunk)
                    continue
                group.append(raw)
                places.append(len(tokens) - 1)
                held += len(raw)
                if held > PIECE_BYTES:
                    flush()
                    held = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([n > limit for n in tokens], pa.bool_())], ["k", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t")).mapInArrow(
        count, f"k {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("k", key)
