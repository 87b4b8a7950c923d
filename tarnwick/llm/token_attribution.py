"""Token counts of fields and their lines, from one encoding of each whole document."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Runs of Unicode's white space that are too long for the pattern's engine, which counts its steps back.
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


class ByteEncoder:
    """Ids of whole texts under a byte-level pattern whose last alternatives are `\\s+(?!\\S)|\\s+` and whose others begin with one space at most.

    Such a pattern makes one piece of a run of white space, without its last character if more text follows. Long runs are
    taken out by that rule and encoded as the piece that they are; what is between them is encoded as usual, so ids are the same.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import tiktoken

        self.usual, self.piece = (tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for name, p in (("own", pattern), ("piece", "(?s:.+)")))

    def ids(self, text: str) -> np.ndarray:
        out, at = [], 0
        for m in _LONG_RUN.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += [self._of(self.usual, text[at : m.start()]), self._of(self.piece, text[m.start() : end])]
            at = end
        return np.concatenate([*out, self._of(self.usual, text[at:])])

    @staticmethod
    def _of(encoder, text: str) -> np.ndarray:
        return np.asarray(encoder.encode_to_numpy(text, disallowed_special=()) if text else [], np.int64)


def byte_encoder(ranks_path: str, pattern: str) -> tuple[ByteEncoder, np.ndarray]:
    """A byte-level encoder and the byte length of each of its ids: their sums are the token offsets."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, no in ranks.items():
        size[no] = len(token)
    return ByteEncoder(ranks, pattern), size


def attribute(starts: np.ndarray, total: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of its own reach beyond its end.

    Sections begin at `starts` and cover all `total` bytes; tokens end at `ends`. A token belongs to the section that
    holds most of its bytes, to the earliest of those on a tie.
    """
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    owner = first.copy()
    for t in np.flatnonzero(last > first):
        edges = np.concatenate([[begins[t]], starts[first[t] + 1 : last[t] + 1], [ends[t]]])
        owner[t] = first[t] + int(np.diff(edges).argmax())
    over = owner[ends > np.append(starts[1:], total)[owner]]
    return np.bincount(owner, minlength=len(starts)), np.bincount(over, minlength=len(starts))


def count_tokens(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """(id, field, section, start, stop, n_tokens, n_crossing) for each line of each field of each row of df.

    The document is its fields, joined by line feeds, encoded once as a whole; a line includes the line feed that ends it. Offsets
    are code points of the document. Token spans follow from the lengths of the tokens and are merged with
    the sections in order, so a document costs one pass. Counts of a document's sections add up to its tokens:
    a token across a boundary goes to the section that holds most of its bytes, to the earlier one on a tie,
    and n_crossing says how many of a section's tokens end beyond it. Null fields count as
    empty; an empty field is one section without characters (its line feed aside); repeated rows come back as often as
    they came; an empty table gives an empty result; other columns are not looked at, whatever their names. Very long texts
    are encoded whole, long runs of white space included.
    """
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, field string, section int, start long, stop long, n_tokens long, n_crossing long"

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, size = byte_encoder(ranks_path, pattern)
        for frame in frames:
            at, budget = 0, 0
            parts: list[list] = [[] for _ in range(7)]
            for key, *texts in frame.itertuples(index=False):
                bounds = [("" if x is None else x) + ("\n" if n + 1 < len(fields) else "") for n, x in enumerate(texts)]
                whole = "".join(bounds)
                data = np.frombuffer(whole.encode("utf-8", "replace"), np.uint8)
                ids = encoder.ids(whole)
                base, starts, names, no = 0, [], [], []
                for field, text in zip(fields, bounds, strict=True):
                    length = len(text.encode("utf-8", "replace"))
                    lines = base + 1 + np.flatnonzero(data[base : base + length] == 10)
                    own = np.concatenate([[base], lines[lines < base + length]])
                    starts.append(own)
                    names += [field] * len(own)
                    no.append(np.arange(len(own)))
                    base += length
                begin = np.concatenate(starts).astype(np.int64)
                # a field without bytes begins where the next one does: the later one owns the bytes
                tokens, over = attribute(begin, base, np.cumsum(size[ids]))
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                edge = points[np.append(begin, base)]
                for column, values in zip(parts, ([key] * len(names), names, np.concatenate(no), edge[:-1], edge[1:], tokens, over), strict=True):
                    column.extend(values)
                at, budget = at + 1, budget + len(data)
                if budget > 8 << 20:
                    yield pd.DataFrame(dict(zip([id_col, "field", "section", "start", "stop", "n_tokens", "n_crossing"], parts, strict=True)))
                    parts, budget = [[] for _ in range(7)], 0
            if parts[0]:
                yield pd.DataFrame(dict(zip([id_col, "field", "section", "start", "stop", "n_tokens", "n_crossing"], parts, strict=True)))

    return df.select(id_col, *[F.col(x).cast("string").alias(x) for x in fields]).mapInPandas(counted, schema)
