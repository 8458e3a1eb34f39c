"""BPE encoding by a bounded-lookahead streaming transducer, and decoding by an
incremental state machine.

A token sequence is the BPE encoding of its text if and only if each two
neighbours encode to themselves.  Hence every prefix of a word has exactly one
last token that may follow the encoding of what is before it, and an encoding
of a longer text continues one of the prefixes that end within the last
``lookahead`` symbols (``lookahead`` = longest token that the merge list can
make).  The transducer therefore reads symbol by symbol, keeps one
(last token, its start) entry for each *live* prefix, and emits a token as soon
as all live prefixes agree on it: no later symbol can change it.  Its memory is
the span on which they disagree, not the text.

Vocabulary, merges, normaliser and splitting rule come from a public
tokenizer file whose path is a parameter; the file's content is read by the
driver and broadcast (its size is that of the vocabulary), so executors need no
such file.  Tokenizers are never trained.

Defined cases: null text counts as empty (no tokens, empty decoded text); the
strings of the file's special tokens become their ids, as in the library; lone
surrogates can't occur in a column; repeated rows are encoded one by one.
"""

from __future__ import annotations

import hashlib
import json
import operator
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartlift.llm.common import row_chunks

#: White space as Unicode defines it (str.split() would also cut at \x1c-\x1f).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACES = re.compile(f"[{SPACE}]+")
_ODD_SPACES = re.compile("[\x1c-\x1f]")


@cache
def byte_alphabet() -> list[str]:
    """Printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others for U+0100 onwards."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


@cache
def byte_values() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_alphabet())}


SHORT = (2, 1)


class Merges:
    """Vocabulary and merge list, with the facts that the transducer needs.

    Tokens are numbered by the vocabulary; ``START`` stands for a word's start.
    """

    START = -1

    def __init__(self, vocab: dict[str, int], merges: Iterable, suffix: str | None):
        self.vocab, self.suffix = vocab, suffix or ""
        self.text = {i: t for t, i in vocab.items()}
        self.rank = {tuple(m) if not isinstance(m, str) else tuple(m.split(" ")): i for i, m in enumerate(merges)}
        self.known: dict[tuple[int, int], bool] = {}
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.lookahead = max((len(self._symbols(a + b)) for a, b in self.rank), default=1)
        lengths: dict[str, set[int]] = {}
        for token in vocab:
            tail = self.suffix if self.suffix and token.endswith(self.suffix) else ""
            body = token[:len(token) - len(tail)]
            if len(body) > 2:
                lengths.setdefault(body[-3:] + tail, set()).add(len(body))
        # lengths, longest first, of the tokens that may end in three given symbols (and the word's end)
        self.lengths = {k: (*sorted(v, reverse=True), *SHORT) for k, v in lengths.items()}

    def _symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[:-len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _edges(self, token: int) -> tuple[list, list] | None:
        """The pieces at a token's left and at its right end while the merge
        list builds it, as (piece, rank that made it, rank that merged it
        further); None if the merge list builds something else."""
        if token in self.edges:
            return self.edges[token]
        parts = self._symbols(self.text[token])
        left, right = [[parts[0], -1]], [[parts[-1], -1]]
        end = len(self.rank)
        while len(parts) > 1:
            r, i = min((self.rank.get(pair, end), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if r == end:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            for at, spine in ((0, left), (len(parts) - 1, right)):
                if i == at:
                    spine[-1].append(r)
                    spine.append([parts[i], r])
        found = None
        if len(parts) == 1:
            for spine in (left, right):
                spine[-1].append(end)
            found = ([tuple(x) for x in left], [tuple(x) for x in right])
        self.edges[token] = found
        return found

    def valid(self, a: int, b: int) -> bool:
        """Do the neighbours ``a`` (or START) and ``b`` encode to themselves?

        They do unless some rule joins the piece at a's right end with the
        piece at b's left end while both exist.  With equal rules the leftmost
        pair merges first.
        """
        left_of_b = self._edges(b)
        if left_of_b is None or a != self.START and self._edges(a) is None:
            return False
        if a == self.START:
            return True
        for piece_a, made_a, gone_a in self._edges(a)[1]:
            for piece_b, made_b, gone_b in left_of_b[0]:
                r = self.rank.get((piece_a, piece_b))
                if r is not None and made_a < r and made_b < r and r < gone_a and r <= gone_b:
                    return False
        return True


class Encoder:
    """Streaming transducer for one word: ``push`` its symbols, then ``finish``
    with the last one; ``word`` for short words."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.early = 4 * merges.lookahead
        self.prefixes: dict[str, tuple[int | None, int]] = {}  # entries of short words' prefixes
        self.reset()

    def reset(self) -> None:
        self.symbols = ""                                  # symbols after the tokens emitted so far
        self.last: list[int | None] = [Merges.START]       # last token of each live or older prefix
        self.start: list[int] = [0]                        # where it starts

    def _step(self, end: int, tail: str) -> None:
        """Find the last token of the prefix of ``end`` symbols."""
        m, text, last = self.merges, self.symbols, self.last
        vocab, known = m.vocab, m.known
        for at in range(end - 1, max(0, end - m.lookahead) - 1, -1):
            token = vocab.get(text[at:end] + tail)
            if token is None:
                continue
            before = last[at]
            if before is None:
                continue
            key = (before, token)
            ok = known.get(key)
            if ok is None:
                if len(known) >= 1_000_000:
                    known.clear()
                ok = known[key] = m.valid(before, token)
            if ok:
                last.append(token)
                self.start.append(at)
                return
        last.append(None)  # a symbol outside the vocabulary: no encoding ends here
        self.start.append(end - 1)

    def _chain(self, end: int) -> list[tuple[int, int]]:
        out = []
        while end > 0 and self.last[end] is not None:
            out.append((end, self.last[end]))
            end = self.start[end]
        return out[::-1]

    def push(self, symbol: str) -> list[int]:
        """Tokens that became stable with this symbol."""
        self.symbols += symbol
        end = len(self.symbols)
        self._step(end, "")
        if end < self.early or end % self.merges.lookahead:
            return []
        live = [self._chain(e) for e in range(max(0, end - self.merges.lookahead + 1), end + 1)
                if self.last[e] is not None]
        agreed = []
        for step in zip(*live):
            if any(x != step[0] for x in step):
                break
            agreed.append(step[0])
        if agreed:
            cut = agreed[-1][0]
            self.symbols, self.last = self.symbols[cut:], self.last[cut:]
            self.start = [max(0, s - cut) for s in self.start[cut:]]
        return [t for _, t in agreed]

    def finish(self, symbol: str) -> list[int]:
        """Tokens left after the word's last symbol."""
        self.symbols += symbol
        self._step(len(self.symbols), self.merges.suffix)
        out = [t for _, t in self._chain(len(self.symbols))]
        self.reset()
        return out

    def word(self, symbols: str) -> list[int]:
        """The same entries for a word from which nothing could be emitted
        early, found on demand from its end, longest tokens first.  An entry
        belongs to a prefix, whatever follows it, so words share them."""
        token, start = self._entry(symbols, self.merges.suffix)
        if token is None:
            return []
        out = [token]
        while start:
            token, start = self._prefix(symbols[:start])
            out.append(token)
        out.reverse()
        return out

    def _prefix(self, text: str) -> tuple[int | None, int]:
        """Last token of a prefix and where it starts; remembered."""
        got = self.prefixes.get(text)
        if got is None:
            got = self._entry(text, "")
            if len(self.prefixes) >= 300_000:
                self.prefixes.clear()
            self.prefixes[text] = got
        return got

    def _entry(self, text: str, tail: str) -> tuple[int | None, int]:
        m, end = self.merges, len(text)
        vocab, known, prefixes = m.vocab, m.known, self.prefixes
        for size in m.lengths.get(text[-3:] + tail, SHORT) if end > 2 else SHORT:
            at = end - size
            if at < 0:
                continue
            token = vocab.get(text[at:] + tail)
            if token is None:
                continue
            if at:
                before = (prefixes.get(text[:at]) or self._prefix(text[:at]))[0]
                if before is None:
                    continue
            else:
                before = Merges.START
            key = (before, token)
            ok = known.get(key)
            if ok is None:
                if len(known) >= 1_000_000:
                    known.clear()
                ok = known[key] = m.valid(before, token)
            if ok:
                return token, at
        return None, max(0, end - 1)  # a symbol outside the vocabulary: no encoding ends here


class Decoder:
    """Incremental decoding: ``push`` gives the text that a further id completes.

    With a byte-level decoder in the file bytes are gathered until they form
    whole characters; without a decoder tokens are joined by a space, as the
    library does.
    """

    def __init__(self, tokens: list[str], special: set[int], byte_level: bool):
        self.tokens, self.special, self.byte_level = tokens, special, byte_level
        self.bytes = byte_values()
        self.held, self.begun = b"", False

    def push(self, token_id: int) -> str:
        token = self.tokens[token_id]
        if not self.byte_level:
            out = (" " if self.begun else "") + token
            self.begun = True
            return out
        if token_id in self.special:
            return self.flush() + token
        data = self.held + bytes(self.bytes[c] for c in token)
        cut = len(data) - self._open(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def push_all(self, ids: list[int]) -> str:
        if self.byte_level or not ids:
            return "".join(map(self.push, ids))
        out = (" " if self.begun else "") + " ".join(map(self.tokens.__getitem__, ids))
        self.begun = True
        return out

    @staticmethod
    def _open(data: bytes) -> int:
        """Length of an unfinished character at the end."""
        for n in range(1, min(4, len(data) + 1)):
            lead = data[-n]
            if lead >= 0xC0:
                return n if n < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) else 0
            if lead < 0x80:
                return 0
        return 0

    def flush(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


_COUNT, _NUMBERS, _TEXT = map(operator.itemgetter, range(3))


class ShownWords(dict):
    """word -> (number of ids, ids as text, tokens as text).

    Two generations of at most ``limit`` words: a full one becomes the older
    one, from which words that occur again come back, so common words stay.
    """

    def __init__(self, tok: Tokenizer, limit: int):
        super().__init__()
        self.tok, self.limit, self.older = tok, limit, {}

    def __missing__(self, word: str) -> tuple[int, str, str]:
        got = self.older.get(word)
        if got is None:
            ids = self.tok._word(word)
            got = len(ids), " ".join(map(str, ids)), " ".join(map(self.tok.tokens.__getitem__, ids))
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = got
        return got


class Tokenizer:
    """A public tokenizer file (BPE model) behind the transducer."""

    def __init__(self, content: str, remembered: int = 400_000):
        spec = json.loads(content)
        self.content, self.library = content, None
        model = spec["model"]
        if model.get("type", "BPE") != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError("only plain BPE models are supported")
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix"))
        self.ids = dict(model["vocab"])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = max([*self.ids.values(), *self.added.values()]) + 1
        self.tokens = [""] * size
        for t, i in [*self.ids.items(), *self.added.items()]:
            self.tokens[i] = t
        steps = self._flat(spec.get("normalizer"), "normalizers")
        self.nfc = any(s["type"] == "NFC" for s in steps)
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        if {s["type"] for s in steps} - {"NFC", "Lowercase", "Replace"}:
            raise ValueError("unsupported normaliser")
        split = next((s for s in self._flat(spec.get("pre_tokenizer"), "pretokenizers") if s["type"] == "Split"), None)
        if split is None or not split.get("invert") or split.get("behavior") != "Removed":
            raise ValueError("only a splitting rule that keeps its matches is supported")
        self.split = regex.compile(split["pattern"]["Regex"].replace("\\s", SPACE if "[^\\s" in split["pattern"]["Regex"]
                                                                      else f"[{SPACE}]"))
        self.special_text = (re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)))
                             if self.added else None)
        self.byte_level_decoder = any(s["type"] == "ByteLevel" for s in self._flat(spec.get("decoder"), "decoders"))
        self.alphabet = byte_alphabet()
        self.symbols = {b: self.alphabet[b] for b in range(256)}
        self.remembered = remembered
        self.words: dict[str, tuple[int, ...]] = {}     # of white-space separated pieces
        self.parts: dict[str, tuple[int, ...]] = {}     # of matches of the splitting rule
        self.shown = ShownWords(self, remembered)
        self.encoder = Encoder(self.merges)

    @staticmethod
    def _flat(node, key: str) -> list[dict]:
        return [] if not node else node[key] if node["type"] == "Sequence" else [node]

    def stream(self, part: str) -> Iterator[int]:
        """Ids of one part, each as soon as it is stable."""
        alphabet, before = self.alphabet, None
        for ch in part:
            for b in ch.encode("utf-8", "surrogatepass"):
                if before is not None:
                    yield from self.encoder.push(before)
                before = alphabet[b]
        if before is not None:
            yield from self.encoder.finish(before)

    def _part(self, part: str) -> tuple[int, ...]:
        if len(part) * 4 > self.encoder.early:
            return tuple(self.stream(part))
        data = part.encode("utf-8", "surrogatepass")
        return tuple(self.encoder.word(data.decode("latin-1").translate(self.symbols)))

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a white-space separated piece of raw text.  White space
        separates normalisation too, so words can be remembered as they stand."""
        if not word.isascii() and any(unicodedata.category(c) == "Cn" for c in word):
            return self._newer_word(word)
        out: list[int] = []
        for part in self.split.findall(self._normal(word)):
            known = self.parts.get(part)
            if known is None:
                known = self._part(part)
                if len(part) <= 64:
                    if len(self.parts) >= self.remembered:
                        self.parts.clear()
                    self.parts[part] = known
            out += known
        return tuple(out)

    def _newer_word(self, word: str) -> tuple[int, ...]:
        """A word with characters newer than Python's Unicode tables: the
        library's own tables fold and split it, the merges are as above."""
        if self.library is None:
            self.library = tokenizers.Tokenizer.from_str(self.content)
        folded = self.library.normalizer.normalize_str(word) if self.library.normalizer else word
        out: list[int] = []
        for symbols, _ in self.library.pre_tokenizer.pre_tokenize_str(folded):
            for s in symbols[:-1]:
                out += self.encoder.push(s)
            out += self.encoder.finish(symbols[-1])
        return tuple(out)

    def _normal(self, text: str) -> str:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:  # letter by letter: no final-sigma rule
            text = (text.replace("\u03a3", "\u03c3") if not text.isascii() else text).lower()
        return text

    def segments(self, text: str | None) -> Iterator[list[str] | int]:
        """White-space separated words of each stretch of a text, and the ids of the added tokens between."""
        at = 0
        for m in self.special_text.finditer(text) if text and self.special_text else ():
            yield self._words(text[at:m.start()])
            yield self.added[m[0]]
            at = m.end()
        if text:
            yield self._words(text[at:] if at else text)

    @staticmethod
    def _words(text: str) -> list[str]:
        return _SPACES.split(text) if _ODD_SPACES.search(text) else text.split()

    def pieces(self, text: str | None) -> Iterator[tuple[int, ...]]:
        """Ids of a text, word by word."""
        known = self.words
        for segment in self.segments(text):
            if isinstance(segment, int):
                yield (segment,)
                continue
            yield from self._known(segment, known)

    def _known(self, words: list[str], known: dict) -> Iterator[tuple[int, ...]]:
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = self._word(w)
                if len(w) <= 64:
                    if len(known) >= self.remembered:
                        known.clear()
                    known[w] = ids
            yield ids

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.pieces(text) for i in ids]

    def decode(self, ids: Iterable[int]) -> str:
        d = Decoder(self.tokens, set(self.added.values()), self.byte_level_decoder)
        return d.push_all(list(ids)) + d.flush()


def encode_column(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All rows and columns, with the array of token ids appended."""
    def run(tok, texts):
        return [pa.array([tok.encode(t) for t in texts], pa.list_(pa.int32()))]

    return _with_tokenizer(docs, tokenizer_path, text_col, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], run)


def decode_column(docs: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All rows and columns, with the decoded text appended (null ids count as none)."""
    def run(tok, ids):
        return [pa.array([tok.decode(i or []) for i in ids], pa.string())]

    return _with_tokenizer(docs, tokenizer_path, ids_col, [T.StructField(text_col, T.StringType())], run)


def digest_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """All rows and columns, with n_tokens and the digests of ids and decoded
    text appended.  Ids stream word by word into the decoder and both digests."""
    def run(tok, texts):
        out = [_digest(tok, t) for t in texts]
        return [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()),
                pa.array([o[2] for o in out], pa.string())]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    return _with_tokenizer(docs, tokenizer_path, text_col, fields, run)


def _digest(tok: Tokenizer, text: str | None, block: int = 4096) -> tuple[int, str, str]:
    return (_digest_bytes if tok.byte_level_decoder else _digest_words)(tok, text, block)


def _digest_words(tok: Tokenizer, text: str | None, block: int) -> tuple[int, str, str]:
    """Without a byte-level decoder tokens are decoded one by one, so number,
    ids and text of a word can be remembered; a block of words is three joins."""
    ids_sha, text_sha, n = hashlib.sha256(), hashlib.sha256(), 0
    for segment in tok.segments(text):
        added = isinstance(segment, int)
        for at in range(0, 1 if added else len(segment), block):
            entries = ([(1, str(segment), tok.tokens[segment])] if added
                       else list(map(tok.shown.__getitem__, segment[at:at + block])))
            count = list(map(_COUNT, entries))
            if 0 in count:
                entries = [e for e in entries if e[0]]
            if entries:
                lead = " " if n else ""
                ids_sha.update((lead + " ".join(map(_NUMBERS, entries))).encode())
                text_sha.update((lead + " ".join(map(_TEXT, entries))).encode("utf-8", "surrogatepass"))
                n += sum(count)
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


def _digest_bytes(tok: Tokenizer, text: str | None, block: int) -> tuple[int, str, str]:
    ids_sha, text_sha, n = hashlib.sha256(), hashlib.sha256(), 0
    decoder = Decoder(tok.tokens, set(tok.added.values()), tok.byte_level_decoder)
    held: list[int] = []

    def flush() -> None:
        ids_sha.update(((" " if n else "") + " ".join(map(str, held))).encode())
        text_sha.update(decoder.push_all(held).encode("utf-8", "surrogatepass"))

    for ids in tok.pieces(text):
        held += ids
        if len(held) >= block:
            flush()
            n += len(held)
            held = []
    if held:
        flush()
        n += len(held)
    text_sha.update(decoder.flush().encode("utf-8", "surrogatepass"))
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


_TOKENIZERS: dict[str, Tokenizer] = {}  # of this worker process, by the file's digest


def _tokenizer(content: str) -> Tokenizer:
    """The process's tokenizer for a file: words known from one task serve the
    next one.  One file at a time is held."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = Tokenizer(content)
    tok = _TOKENIZERS[key]
    tok.encoder.reset()  # a task that failed may have left a word half read
    return tok


def _with_tokenizer(docs: DataFrame, path: str, col: str, fields: list[T.StructField], fn) -> DataFrame:
    with open(path, encoding="utf-8") as fh:
        shared = docs.sparkSession.sparkContext.broadcast(fh.read())

    def run(batches):
        tok = _tokenizer(shared.value)
        for b in batches:
            parts = [fn(tok, [r[0] for r in rows]) for rows in row_chunks([b], [col])]
            new = [pa.concat_arrays([p[i] for p in parts]) for i in range(len(fields))] if parts else []
            if parts:
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *[f.name for f in fields]])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
