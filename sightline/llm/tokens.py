"""Encode whole texts with the tokenizers library, at the price of its distinct words.

A byte-level pre-tokenizer never carries a token across a single white space that stands between two other characters:
the white space begins the next pre-token or is one. So a text is cut before such spaces and newlines, and its ids are
those of its chunks, one after the other. A word's closing marks are a pre-token of their own. Every chunk is encoded by
the library itself, many in one call, and kept for the next time; texts with a special token's string go to it whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

from sightline.llm.common import release_memory

#: Kept chunks of one generation; the one before stays readable, so a task holds twice as many at most.
KEPT = 250_000
#: Bytes of text encoded at a time.
SLICE = 1 << 23

#: Chunks in one text for the library, which takes longer for each in a long text.
JOINED = 64

#: White space, a run of letters (one pre-token with a space before it), and a run of marks after it (another).
_WORD = r"^(?P<stem>[ \n][A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<marks>[.,;:!?|%&$#*]*)$"
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Everything that either library takes for white space.
_WHITE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
_WHITE_RUN = f"[{_WHITE}]{{2}}"
#: Chunks that stay apart in one text: a space or newline, and no other white space.
_APART = f"^[ \n][^{_WHITE}]+$"


class Encoder:
    def __init__(self, path: str, kept: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept = KEPT if kept is None else kept
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocab.values(), default=0) + 1, bool)  # tokens that begin with a space, and the newline
        self.leads[[i for t, i in vocab.items() if t[:1] == "Ġ" or t == "Ċ"]] = True
        self._clear()

    def _clear(self) -> None:
        """Nothing kept: chunks with their places, all their ids in a row, and where each place's end (after a first 0)."""
        import numpy as np

        self.places: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.before = self.places, self.ids, self.ends

    def _keep(self, chunks: list[str], ids, sizes) -> None:
        import numpy as np

        self.places.update(zip(chunks, range(len(self.ends) - 1, len(self.ends) - 1 + len(chunks)), strict=True))
        self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def _alone(self, texts: list[str]):
        """The library's ids of texts, one after the other, and their numbers."""
        import numpy as np

        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), "<u4", int(sizes.sum())), sizes

    def _together(self, chunks: list[str]):
        """As `_alone`, for chunks that stay apart in one text: each begins where a token has a space or is a newline."""
        import numpy as np

        ids, sizes = self._alone(["".join(chunks[at : at + JOINED]) for at in range(0, len(chunks), JOINED)])
        lead = self.leads[ids]
        starts = np.flatnonzero(lead)
        return (ids, np.diff(starts, append=len(ids))) if len(starts) == len(chunks) and lead[np.cumsum(sizes) - sizes].all() else self._alone(chunks)

    def _places_of(self, chunks):
        """Places of an array's chunks among the kept ones, after the new ones have been encoded."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names = chunks.to_numpy(zero_copy_only=False).tolist()
        if new := [c for c in names if c not in self.places]:
            older, ids, ends = self.before
            if again := [c for c in new if c in older]:
                at = np.fromiter(map(older.__getitem__, again), np.int64, len(again))
                sizes = ends[at + 1] - ends[at]
                self._keep(again, ids[_ranges(ends[at], sizes)], sizes)
                new = [c for c in new if c not in older]
            apart = pc.match_substring_regex(pa.array(new, pa.string()), _APART).to_pylist()
            made = []
            for some, of in (([c for c, a in zip(new, apart, strict=True) if a], self._together), ([c for c, a in zip(new, apart, strict=True) if not a], self._alone)):
                made += [(some[at : at + 4096], *of(some[at : at + 4096])) for at in range(0, len(some), 4096)]
            if made:
                own, ids, sizes = zip(*made, strict=True)
                self._keep([c for x in own for c in x], np.concatenate(ids), np.concatenate(sizes))
        return np.fromiter(map(self.places.__getitem__, names), np.int64, len(names))

    def _table(self, chunks):
        """Ids of an array of chunks, one after the other, and their numbers. Marks that close a word are looked up apart from it."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        word = pc.extract_regex(chunks, _WORD)
        stems = pc.coalesce(pc.struct_field(word, "stem"), chunks).dictionary_encode()
        marks = pc.struct_field(word, "marks").fill_null("").dictionary_encode()
        places = self._places_of(pa.concat_arrays([stems.dictionary, marks.dictionary]))
        of = np.stack([places[stems.indices.to_numpy()], places[len(stems.dictionary) + marks.indices.to_numpy().astype(np.int64)]], 1)
        sizes = self.ends[of + 1] - self.ends[of]
        return self.ids[_ranges(self.ends[of].ravel(), sizes.ravel())], sizes.sum(1)

    def encode(self, texts):
        """`_encode` without cycle collection: it makes no cycles, and the collector would walk all that is kept."""
        import gc

        if not gc.isenabled():
            return self._encode(texts)
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts):
        """Ids of all texts, one after the other, and where each text's begin (one more entry than texts); null counts as empty.

        A text is split, its chunks numbered and closing marks cut off by Arrow, so Python sees each different word of a batch once.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = (pa.array(texts, pa.string()) if isinstance(texts, list) else texts).fill_null("")
        n = len(texts)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        special = np.zeros(n, bool)
        for mark in self.special:
            special |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        runs = pc.match_substring_regex(texts, _WHITE_RUN).to_numpy(zero_copy_only=False) & ~special
        groups = [np.flatnonzero(~special & ~runs), np.flatnonzero(runs), np.flatnonzero(special)]
        plain = pc.split_pattern(pc.replace_substring(texts.take(pa.array(groups[0])), "\n", " \n"), " ")
        spaced = pa.array([_SINGLE_SPACE.split(t) for t in texts.take(pa.array(groups[1])).to_pylist()], plain.type)
        parts = pa.concat_arrays([plain, spaced])
        offsets = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        codes, chunks = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        first, heads = np.unique(codes[offsets[:-1]], return_inverse=True)
        follows = np.ones(len(codes), bool)
        follows[offsets[:-1]] = False
        used = np.zeros(len(chunks), bool)
        used[codes[follows]] = True
        after = chunks.filter(pa.array(used))
        after = pc.if_else(pc.starts_with(after, "\n"), after, pc.binary_join_element_wise(" ", after, ""))
        if len(self.places) > self.kept:
            self.before = self.places, self.ids, self.ends
            self.places, self.ids, self.ends = {}, self.ids[:0], self.ends[:1]
        codes[offsets[:-1]] = len(after) + heads
        codes[follows] = (np.cumsum(used) - 1)[codes[follows]]
        known, sizes = self._table(pa.concat_arrays([after, chunks.take(pa.array(first))]))
        whole, whole_sizes = self._alone(texts.take(pa.array(groups[2])).to_pylist())
        known, sizes = np.concatenate([known, whole]), np.concatenate([sizes, whole_sizes])
        codes = np.concatenate([codes, np.arange(len(sizes) - len(groups[2]), len(sizes))])
        numbers = np.concatenate([np.diff(offsets), np.ones(len(groups[2]), np.int64)])
        if len(groups[0]) < n:
            back = np.argsort(np.concatenate(groups))
            codes = codes[_ranges((np.cumsum(numbers) - numbers)[back], numbers[back])]
            numbers = numbers[back]
        lengths = sizes[codes]
        ids = known[_ranges((np.cumsum(sizes) - sizes)[codes], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(numbers)])]
        return ids, ends

    def forget(self) -> None:
        """Give the kept chunks back at the end of a task, so idle workers stay small."""
        self._clear()
        release_memory()


def _ranges(starts, lengths):
    """The places starts[0].., lengths[0] of them, then starts[1].., and so on."""
    import numpy as np

    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def slices(batch, rows: int = 4096, size: int = SLICE) -> Iterator:
    """A record batch with `text` in slices of so many rows and bytes at most (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.binary_length(batch["text"]).fill_null(0).to_numpy()
    ends, at = np.cumsum(lengths), 0
    while at < batch.num_rows:
        limit = (ends[at - 1] if at else 0) + size
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, limit, "right"))))
        yield batch.slice(at, end - at)
        at = end


def encoder(path: str, kept: int = KEPT) -> Encoder:
    """This process's encoder, with at most `kept` chunks of a generation. It hangs on the library's module because functions reach executors by value, without this one."""
    import tokenizers

    known = tokenizers.__dict__.setdefault("_kept_encoders", {})
    if path not in known:
        known[path] = Encoder(path)
    known[path].kept = kept
    return known[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
