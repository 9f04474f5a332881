"""Token ids of whole texts, by the tokenizers library.

Where a tokenizer's normaliser and pre-tokens never reach across ASCII white space (`separable` tells from
its file), a text's ids are those of its parts between white space, one after the other. Then a batch's
distinct parts are found by dictionary encoding, each is encoded once, and the ids of the texts are gathered
from one buffer. Any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

END_ID = 1
JOINED = 200
BATCH_BYTES, STEP_BYTES, WORDS = 20_000_000, 2_000_000, 50_000
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: Normalisers and pre-tokenizers (types in order) and the pattern that leave white space out of every pre-token: fixed values.
SEPARABLE_NORMALIZERS = ("NFC", "Replace", "Lowercase")
SEPARABLE_PRE_TOKENIZERS = ("Split", "ByteLevel")
SEPARABLE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def separable(path: str) -> bool:
    """Whether white space always ends a pre-token and the normaliser works on each part alone."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    steps = (held.get("normalizer") or {}).get("normalizers", [])
    cuts = (held.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if tuple(s["type"] for s in steps) != SEPARABLE_NORMALIZERS or tuple(s["type"] for s in cuts) != SEPARABLE_PRE_TOKENIZERS:
        return False
    return (
        (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) == ({"Regex": SEPARABLE_PATTERN}, "Removed", True)
        and not (cuts[1]["add_prefix_space"] or cuts[1]["use_regex"])
    )


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_parts = separable(path)
        if self.by_parts:
            names = self.tokenizer.get_vocab()
            self.last = np.zeros(max(names.values()) + 1, bool)  # the ids that end a pre-token
            self.last[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def encode(self, column, end_id: int | None = END_ID):
        """For some of the texts of an Arrow string column after the other: the first one's row, their ids (unsigned 32 bit) one after the other with end_id behind each text, and the n + 1 places where texts begin."""
        import pyarrow as pa
        import pyarrow.compute as pc

        for low, texts in slices(column, BATCH_BYTES if self.by_parts else STEP_BYTES):
            texts = texts.cast(pa.large_string()).fill_null("")
            if not self.by_parts:
                ids, sizes = self.lists(texts.to_pylist())
                yield low, *ended(ids, sizes, end_id)
                continue
            words = pc.ascii_split_whitespace(texts)
            held = words.flatten().dictionary_encode()
            places = words.offsets.to_numpy() - words.offsets[0].as_py()
            bounds = [(first, len(some)) for first, some in slices(texts, STEP_BYTES)]
            del words, texts
            flat, sizes, begin = self.words(held.dictionary)
            index = held.indices.to_numpy()
            for first, count in bounds:
                at = places[first : first + count + 1]
                part = index[at[0] : at[-1]]
                size = sizes[part]
                ends = np.cumsum(size, dtype=np.int64)
                kind = np.int32 if len(part) < 1 << 24 else np.int64
                move = (begin[part] - (ends - size)).astype(kind)
                places_of = np.repeat(move, size)
                places_of += np.arange(len(places_of), dtype=kind)
                yield low + first, *ended(flat[places_of], np.diff(np.concatenate([[0], ends])[at - at[0]]), end_id)
            del held, flat, index
            trim()

    def lists(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        out, sizes = [np.zeros(0, np.uint32)], []
        for i in range(0, len(texts), 256):
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
            sizes += map(len, found)
            out += found
        return np.concatenate(out), np.array(sizes, np.int64)

    def words(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words of an Arrow column in some order, how many each has, and where it begins. A word of letters is one pre-token, with punctuation behind it two, so joined words can be told apart by the ids that end pre-tokens; other words go alone."""
        out, sizes, begin, used = [np.zeros(0, np.uint32)], np.zeros(len(column), np.int32), np.zeros(len(column), np.int64), 0
        for low in range(0, len(column), WORDS):
            words = column.slice(low, WORDS).to_pylist()
            cuts = np.array([1 if w.isalpha() else 2 if w.rstrip(PUNCTUATION).isalpha() else 0 for w in words], np.int8)
            order = np.concatenate([np.flatnonzero(cuts == k) for k in (1, 2, 0)])
            found = []
            for k in (1, 2):
                some = [words[i] for i in np.flatnonzero(cuts == k)]
                for i in range(0, len(some), JOINED):
                    group = some[i : i + JOINED]
                    ids, _ = self.lists([" ".join(group)])
                    ends = np.flatnonzero(self.last[ids])
                    if len(ends) == k * len(group):
                        found.append((ids, np.diff(np.concatenate([[-1], ends[k - 1 :: k]]))))
                    else:  # a letter whose lower case is no letter alone
                        found.append(self.lists(group))
            found.append(self.lists([words[i] for i in np.flatnonzero(cuts == 0)]))
            count = np.concatenate([n for _, n in found])
            sizes[low + order], begin[low + order] = count, used + np.cumsum(count) - count
            out += [ids for ids, _ in found]
            used += int(count.sum())
        return np.concatenate(out), sizes, begin


def ended(ids: np.ndarray, sizes: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """ids of texts with end_id behind each text, and the places where texts begin."""
    more = end_id is not None
    edges = np.concatenate([[0], np.cumsum(sizes + more)]).astype(np.int64)
    if more:
        out, own = np.empty(int(edges[-1]), np.uint32), np.ones(int(edges[-1]), bool)
        own[edges[1:] - 1] = False
        out[own], out[~own] = ids, end_id
        ids = out
    return ids, edges


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def slices(column, most: int):
    """Slices (first row, column) of an Arrow string column of at most `most` bytes each (or one text), to bound the memory of a step."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = done = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield low, column.slice(low, high - low)
        low, done = high, int(sizes[high - 1])


def gathered(batches, most: int | None = None):
    """Record batches put together up to `most` bytes, so that their distinct words are found once."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= (most or BATCH_BYTES):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def utf8(column) -> list[bytes]:
    """Values of an Arrow string column as bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def each(column, size: int = 256):
    """The same one after the other, a few at a time as Python objects."""
    for at in range(0, len(column), size):
        yield from utf8(column.slice(at, size))


def trim() -> None:
    """Gives memory that the allocators hold back to the machine."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def forget() -> None:
    """Frees what earlier tasks left in this worker: encoders and memory held by the allocators."""
    encoder.cache_clear()
    trim()
