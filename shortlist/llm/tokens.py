"""Token ids of whole texts from a public tokenizer file, as little-endian 32-bit bytes.

A byte-level tokenizer of this kind never joins a character with the single blank that follows it, nor a
letter with a final stop or comma, so a text whose only blanks are single spaces and single line ends,
none at its edges, is the sequence of its blank-led units, a stop or comma behind a letter being one of
its own. Such units repeat, so each worker remembers the ids of units it has seen; the ids always come
from the tokenizer. Any other text is encoded as it is.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa

from shortlist.llm.common import ranges, worker_cache

VOCABULARY = "byte_bpe_50k.json"
CACHE_BYTES = 128 << 20  # of a worker's remembered units; those not met for half of it are forgotten
AT_ONCE = 5000  # new units that are encoded as one text
TEXTS_AT_ONCE = 2 << 20  # characters of texts whose units are looked up together
_SPECIAL = "<|endoftext|>"
_OTHER = re.compile(r"[^\S \n]")  # other blanks
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])


class Encoder:
    def __init__(self, path: str, plain_specials: bool = False):
        """With `plain_specials` the strings of special tokens are ordinary text."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of a token: a character each
        self.sizes[np.fromiter(vocabulary.values(), np.int64, len(vocabulary))] = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def units(self, units: list[str]) -> list[bytes]:
        """The ids of each space-led unit. They are encoded as one text and cut by their bytes; where a token
        does not end with its unit, they are encoded one by one."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(units)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(self.sizes[ids])
        wanted = np.cumsum(np.fromiter(map(len, map(str.encode, units)), np.int64, len(units)))
        cuts = np.searchsorted(ends, wanted)
        if len(ends) == 0 or ends[-1] != wanted[-1] or (ends[cuts] != wanted).any():
            return self.whole(units)
        data, cuts = ids.tobytes(), ((cuts + 1) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    def ids_of(self, units: list[str]) -> list[bytes]:
        """The ids of each distinct unit, remembered or new."""
        found = list(map(self.known.get, units))
        absent = [at for at, ids in enumerate(found) if ids is None]
        if not absent:
            return found
        again = [units[at] for at in absent]
        ids = list(map(self.older.get, again))
        fresh = [at for at, x in enumerate(ids) if x is None]
        led, single = ([at for at in fresh if (again[at][0] == " ") is first] for first in (True, False))
        for encode, places in ((self.units, led), (self.whole, single)):
            for first in range(0, len(places), AT_ONCE):
                part = places[first : first + AT_ONCE]
                for at, x in zip(part, encode([again[at] for at in part])):
                    ids[at] = x
        for at, x in zip(absent, ids):
            found[at] = x
        self.known.update(zip(again, ids))
        self.held += sum(map(len, again)) + sum(map(len, ids)) + 200 * len(ids)
        if self.held > CACHE_BYTES // 2:
            self.known, self.older, self.held = {}, self.known, 0
        return found

    def joined(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each of some texts that are sequences of units, one look-up for each distinct unit."""
        data = np.frombuffer("\0".join([*texts, ""]).encode(), np.uint8)
        first = np.zeros(len(data) + 1, bool)  # where a unit begins; a text's end is a unit without ids
        ends, lines = data == 0, data == 10
        first[:-1] = blank = ends | lines | (data == 32)
        stops = np.flatnonzero((data == 44) | (data == 46))
        before, lead = data[stops - 1], data[stops - 2]
        letter = _LETTER[before] | ((lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
        first[stops[letter & (stops > 1) & blank[stops + 1]]] = True
        first[1:] |= ends | lines
        first[0] = True
        cuts = np.flatnonzero(first)
        pieces = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        place = pieces.indices.to_numpy()
        units = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = self.ids_of([u for u in units if u != "\0"])
        ids.insert(units.index("\0"), b"")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[place]
        out = np.frombuffer(b"".join(ids), "<u4")[ranges(starts[place], lengths)].tobytes()
        cuts = (4 * np.cumsum(lengths)[ends[cuts[:-1]]]).tolist()
        return (out[a:b] for a, b in zip([0, *cuts], cuts))

    def encode(self, texts: list[str], led: bool = False) -> list[bytes]:
        """The ids of each text, four bytes each; `led` puts a space before every text."""
        out: list[bytes | None] = [None] * len(texts)
        split, held = [], 0
        for at, text in enumerate(texts):
            if not has_units(text) or (led and not text):
                out[at] = self.whole([" " + (text or "") if led else text or ""])[0]
                continue
            split.append(at)
            held += len(text or "")
            if held > TEXTS_AT_ONCE:
                self._encode(texts, split, led, out)
                split, held = [], 0
        if split:
            self._encode(texts, split, led, out)
        return out

    def _encode(self, texts: list[str], places: list[int], led: bool, out: list[bytes | None]) -> None:
        for at, ids in zip(places, self.joined([" " + texts[at] if led else texts[at] or "" for at in places])):
            out[at] = ids


def has_units(text: str | None) -> bool:
    """Whether the ids of the blank-led units joined are certain to be the ids of the text."""
    if not text:
        return True
    if "\0" in text or text[0] in " \n" or text[-1] in " \n" or _SPECIAL in text:
        return False
    return not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or _OTHER.search(text))


def encoder(vocabulary: str = VOCABULARY, plain_specials: bool = False) -> Encoder:
    """The worker's encoder of this vocabulary file; the file is looked up on the executor."""
    cache = worker_cache("encoders")
    key = (vocabulary, plain_specials)
    if key not in cache:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        cache[key] = Encoder(public_tokenizers.path(vocabulary), plain_specials)
    return cache[key]
