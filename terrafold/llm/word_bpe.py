"""BPE encoding by speculation: longest matches are proposed, adjacent tokens checked together, and only failing words merged."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Rank of a pair that no merge takes, and of a part that nothing consumes.
NEVER = np.iinfo(np.int64).max


class Merges:
    """The vocabulary and merges of a BPE model as arrays.

    ``left``, ``right`` and ``rank`` say of each token which merge makes it (rank -1: none does). ``sound`` tokens are what the model makes of
    their own characters, by the one merge that makes them of parts made before; only these are proposed.
    """

    def __init__(self, model: dict):
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = 1 + max(self.vocab.values(), default=0)
        a, b = (np.array([self.vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([self.vocab[m[0] + m[1]] for m in merges], np.int64)
        key, ranks = a * self.size + b, np.arange(len(merges))
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], ranks[order], made
        self.left, self.right, self.rank = np.full(self.size, -1), np.full(self.size, -1), np.full(self.size, -1)
        self.left[made], self.right[made], self.rank[made] = a, b, ranks
        ones = np.bincount(made, minlength=self.size)
        fair = (ones[made] == 1) & (self.rank[a] < ranks) & (self.rank[b] < ranks)
        fair &= self.apart(a, b, ranks)
        good = np.ones(self.size, bool)
        for l, r, t, ok in zip(a.tolist(), b.tolist(), made.tolist(), fair.tolist()):
            good[t] = good[t] and ok and good[l] and good[r]
        self.sound = good
        ends = [(ord(t), i) for t, i in self.vocab.items() if len(t) == 1]
        lasts = [(ord(t[0]), i) for t, i in self.vocab.items() if self.suffix and len(t) == 1 + len(self.suffix) and t.endswith(self.suffix)]
        self.first, self.last = (np.full(1 + max((c for c, _ in some), default=0), -1) for some in (ends, lasts if self.suffix else ends))
        for table_, some in ((self.first, ends), (self.last, lasts if self.suffix else ends)):
            for c, i in some:
                table_[c] = i
        self._trie()

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair; NEVER: none."""
        if not len(self.keys):
            return np.full(len(a), NEVER)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Which pairs of adjacent tokens, each grown from its characters, no merge (before rank ``until``) joins across their border.

        Followed backwards: of the two parts at the border the one made last is cut, and the part of it at the border was there until
        then. A merge across takes two parts that meet there if it comes before either is consumed; of equal ranks the leftmost comes
        first, which is the left part's own merge, then the one across, then the right part's own.
        """
        a, b = a.copy(), b.copy()
        ends_a, ends_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        until = np.full(len(a), NEVER) if until is None else until
        good, open_ = np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            across = self.rank_of(x, y)
            crossed = (across < ends_a[open_]) & (across <= ends_b[open_]) & (across < until[open_])
            good[open_[crossed]] = False
            made_a, made_b = self.rank[x], self.rank[y]
            on = ~crossed & ((made_a >= 0) | (made_b >= 0))
            cut_a = on & (made_a > made_b)
            cut_b = on & ~cut_a
            at = open_[cut_a]
            ends_a[at], a[at] = made_a[cut_a], self.right[x[cut_a]]
            at = open_[cut_b]
            ends_b[at], b[at] = made_b[cut_b], self.left[y[cut_b]]
            open_ = open_[on]
        return good

    def _trie(self) -> None:
        """Edges of the trie of sound tokens over first ids (characters), as sorted keys; the token at each node, -1 for none."""
        spelled: dict[int, tuple[int, ...]] = {}
        for t in sorted(range(self.size), key=lambda t: self.rank[t]):
            r = int(self.rank[t])
            spelled[t] = (t,) if r < 0 else spelled.get(int(self.left[t]), ()) + spelled.get(int(self.right[t]), ())
        edges: dict[int, int] = {}
        tokens = [-1]
        for t in sorted(set(self.vocab.values())):
            if not self.sound[t]:
                continue
            node = 0
            for c in spelled[t]:
                key = node * self.size + c
                if key not in edges:
                    edges[key] = len(tokens)
                    tokens.append(-1)
                node = edges[key]
            tokens[node] = t
        self.edges = np.array(sorted(edges), np.int64)
        self.nodes, self.token = np.array([edges[k] for k in self.edges.tolist()], np.int64), np.array(tokens, np.int64)

    def longest(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At each place of ``ids`` (characters of words one after the other, each place with its word's end) the longest token that
        begins there, and its length."""
        token, length = ids.copy(), np.ones(len(ids), np.int64)
        at, node, depth = np.arange(len(ids)), np.zeros(len(ids), np.int64), 0
        while len(at):
            key = node * self.size + ids[at + depth]
            k = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            on = self.edges[k] == key
            at, node, depth = at[on], self.nodes[k[on]], depth + 1
            found = self.token[node]
            token[at[found >= 0]], length[at[found >= 0]] = found[found >= 0], depth
            on = at + depth < ends[at]
            at, node = at[on], node[on]
        return token, length

    def characters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of the words' characters, the last of each with the suffix; characters without an id are left out."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids, last = self._looked_up(self.first, code), np.cumsum(sizes)[sizes > 0] - 1
        ids[last] = self._looked_up(self.last, code[last])
        if (ids < 0).any():
            known = ids >= 0
            sizes = np.bincount(np.repeat(np.arange(len(words)), sizes)[known], minlength=len(words))
            ids = ids[known]
        return ids, sizes

    @staticmethod
    def _looked_up(table_: np.ndarray, code: np.ndarray) -> np.ndarray:
        return np.where(code < len(table_), table_[np.minimum(code, len(table_) - 1)], -1)

    def merged(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words after all merges. In each round every word takes its merge of lowest rank, the leftmost of equals; words
        with none left are set aside. Only the ranks beside a merge are looked up again."""
        n_words = len(sizes)
        whose = np.repeat(np.arange(n_words), sizes)
        rank = np.full(len(ids), NEVER)
        inner = np.flatnonzero(whose[:-1] == whose[1:])
        rank[inner] = self.rank_of(ids[inner], ids[inner + 1])
        done_ids, done_who = [], []
        while len(ids):
            heads = np.flatnonzero(np.concatenate(([True], whose[1:] != whose[:-1])))
            lens = np.diff(np.append(heads, len(ids)))
            low = np.repeat(np.minimum.reduceat(rank, heads), lens)
            open_ = low < NEVER
            if not open_.all():
                done_ids.append(ids[~open_])
                done_who.append(whose[~open_])
                ids, whose, rank, low = ids[open_], whose[open_], rank[open_], low[open_]
                continue
            hits = np.flatnonzero(rank == low)
            at = hits[np.concatenate(([True], whose[hits[1:]] != whose[hits[:-1]]))]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            ids, whose, rank = ids[keep], whose[keep], rank[keep]
            for k in (moved[moved > 0] - 1, moved):
                after = np.minimum(k + 1, len(ids) - 1)
                inside = (k < after) & (whose[k] == whose[after])
                rank[k] = np.where(inside, self.rank_of(ids[k], ids[after]), NEVER)
        who = np.concatenate(done_who) if done_who else np.zeros(0, np.int64)
        order = np.argsort(who, kind="stable")
        return (np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64))[order], np.bincount(who, minlength=n_words)

    def proposed(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words cut by longest matches from the left."""
        stops = np.cumsum(sizes)
        token, length = self.longest(ids, np.repeat(stops, sizes))
        at, who = (stops - sizes)[sizes > 0], np.flatnonzero(sizes > 0)
        found, of = [], []
        while len(at):
            found.append(token[at])
            of.append(who)
            at = at + length[at]
            on = at < stops[who]
            at, who = at[on], who[on]
        whose = np.concatenate(of) if of else np.zeros(0, np.int64)
        order = np.argsort(whose, kind="stable")
        return (np.concatenate(found) if found else np.zeros(0, np.int64))[order], np.bincount(whose, minlength=len(sizes))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): the ids of all words one after the other, and how many each has."""
        ids, sizes = self.characters(words)
        out, n = self.proposed(ids, sizes)
        whose = np.repeat(np.arange(len(words)), n)
        same = np.flatnonzero(whose[:-1] == whose[1:])
        fails = np.zeros(len(words), bool)
        fails[whose[same[~self.apart(out[same], out[same + 1])]]] = True
        if not fails.any():
            return out, n
        exact, m = self.merged(ids[np.repeat(fails, sizes)], sizes[fails])
        keep = ~fails[whose]
        who = np.concatenate((whose[keep], np.repeat(np.flatnonzero(fails), m)))
        return np.concatenate((out[keep], exact))[np.argsort(who, kind="stable")], np.bincount(who, minlength=len(words))


# Fixed value: how the tokenizer file with word ends cuts its normalised texts, and the same for ASCII alone.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"


class Encoder:
    """Ids of whole texts by a BPE tokenizer file.

    The file's own normaliser and cutting rule give the words; what is merged is decided here. Where the rule drops white space, texts
    are parted there first, and the parts met before are remembered; beyond ROOM, those not met since the last time go. ASCII parts are
    cut by the rule's ASCII form.
    Strings of added tokens are tokens of their own, as the library has it.
    """

    ROOM = 150_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "unk_token") if model.get(k)]
        added = told.get("added_tokens") or []
        odd += [k for t in added for k in ("single_word", "lstrip", "rstrip", "normalized") if t[k]]
        if model.get("type", "BPE") != "BPE" or odd:
            raise ValueError(f"not read: {odd or model['type']}")
        library = Tokenizer.from_file(path)
        self.normalizer, self.cutter = library.normalizer, library.pre_tokenizer
        self.merges = Merges(model)
        self.added = {t["content"]: t["id"] for t in added}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if added else None
        rules = (told.get("pre_tokenizer") or {}).get("pretokenizers") or []
        steps = [x.get("type") for x in (told.get("normalizer") or {}).get("normalizers") or []]
        self.by_parts = bool(rules) and rules[0].get("type") == "Split" and rules[0]["pattern"] == {"Regex": WORD_RULE} and rules[0]["behavior"] == "Removed" and rules[0]["invert"]
        self.by_parts = self.by_parts and [r.get("type") for r in rules[1:]] == ["ByteLevel"] and not rules[1]["use_regex"] and not rules[1]["add_prefix_space"] and steps == ["NFC", "Replace", "Lowercase"]
        self.controls = re.compile("[\x1c-\x1f\x85᠎]").search
        self.blanks, self.ascii = re.compile(r"[ \t-\r]+").split, re.compile(ASCII_RULE).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _words(self, part: str) -> list[str]:
        if self.by_parts and part.isascii():
            if part.isalpha():
                return [part.lower()]
            if part.isprintable():
                return self.ascii(part.lower())
        whole = self.normalizer.normalize_str(part) if self.normalizer else part
        return [w for w, _ in self.cutter.pre_tokenize_str(whole)] if self.cutter else [whole]

    def _learn(self, parts: list[str]) -> None:
        """Remembers the ids of new parts; all their distinct words are encoded together."""
        special = {p for p in parts if any(t in p for t in self.added)}
        words = {p: self._words(p) for p in parts if p not in special}
        cut = {p: [(s, None) if s in self.added else (None, self._words(s)) for s in self.at_added(p) if s] for p in special}
        distinct = list({w for ws in words.values() for w in ws} | {w for pieces in cut.values() for _, ws in pieces for w in ws or ()})
        ids, sizes = self.merges.encode(distinct)
        data, ends = ids.astype(np.int32).tobytes(), (4 * np.cumsum(sizes)).tolist()
        known = dict(zip(distinct, [data[a:b] for a, b in zip([0, *ends], ends)]))
        join = b"".join
        self.known.update((p, known[ws[0]] if len(ws) == 1 else join([known[w] for w in ws])) for p, ws in words.items())
        self.known.update((p, join([np.array([self.added[s]], np.int32).tobytes() if ws is None else join([known[w] for w in ws]) for s, ws in pieces])) for p, pieces in cut.items())

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_parts:
            parts = [[t] for t in texts]
        else:
            # str.split also cuts at controls that the rule takes for characters.
            parts = [[p for p in self.blanks(t) if p] if self.controls(t) else t.split() for t in texts]
        if len(self.known) > self.ROOM:
            self.known, self.older = {}, self.known
        new = list({p for ps in parts for p in ps}.difference(self.known))
        self.known.update((p, self.older[p]) for p in new if p in self.older)
        new = [p for p in new if p not in self.known]
        for at in range(0, len(new), 1 << 15):
            self._learn(new[at : at + (1 << 15)])
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, ps)), np.int32) for ps in parts]
        if not self.by_parts:
            self.known.clear()
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process: what it remembers serves all its tasks."""
    return Encoder(path)


@functools.cache
def token_texts(path: str) -> list[str | None]:
    """The text of each id, added tokens included."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    if told.get("decoder"):
        raise ValueError("not read: a decoder")
    known = told["model"]["vocab"] | {t["content"]: t["id"] for t in told.get("added_tokens") or []}
    out: list[str | None] = [None] * (1 + max(known.values()))
    for text, i in known.items():
        out[i] = text
    return out


#: Characters of text that are encoded at once; a longer text is a block of its own.
BLOCK = 4 << 20


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of each row: what the tokenizers library's encode gives without special tokens around the text.

    Null and empty texts have no ids; repeated rows are encoded each; other columns are ignored, whatever their names. ``tokenizer`` is
    the path of a BPE file on each machine. Nothing is shuffled: a task remembers what it met. Empty input: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            start, held = 0, 0
            for at, n in enumerate(pc.binary_length(b.column(1)).to_pylist()):
                held += n
                if held >= BLOCK or at == b.num_rows - 1:
                    some = b.slice(start, at + 1 - start)
                    ids = encode(some.column(1).to_pylist())
                    offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])
                    start, held = at + 1, 0

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded(doc_id, ids)`` to ``(doc_id, ids, decoded)``: what the library's decode gives, special tokens kept. A file without a decoder
    joins the tokens' own texts by a blank; ids that it does not know are left out. Null ids: null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = token_texts(tokenizer)
        of = np.array([*text, None], object)
        for b in batches:
            out = []
            for ids in b.column(1):
                if ids.values is None:
                    out.append(None)
                    continue
                i = ids.values.to_numpy()
                got = of[np.where((i >= 0) & (i < len(text)), i, len(text))].tolist()
                out.append(" ".join(got if None not in got else [t for t in got if t is not None]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op11_word_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    back = decode_ids(encode_texts(table(spark, sf_dir, "documents"), path), path)
    decimal = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
