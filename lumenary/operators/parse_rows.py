"""Triples, sentences and mentions of parsed documents, each in the row that has it.

A row is ``doc_id, tokens, entities`` with lists of structs. Nothing of a document depends on
another one, so nothing is exchanged: an Arrow batch's tokens are numbered in one row of arrays,
and what were joins on (document, head) are look-ups of numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens that are worked on at once; a longer document is worked on alone.
MOST_TOKENS = 200_000
#: Counted items that are ranked at once.
MOST_ITEMS = 200_000


def parts(batches: Iterable[pa.RecordBatch], most: int = MOST_TOKENS) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of documents of a bounded number of tokens."""
    for rows in batches:
        sizes = _sizes(rows.column(1))
        group = (np.cumsum(sizes) - sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), rows.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield rows.slice(a, b - a)


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _fields(lists: pa.Array) -> dict[str, pa.Array]:
    flat = lists.flatten()
    return {flat.type[k].name: child for k, child in enumerate(flat.flatten())}


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values, nulls as 0, and which are not null."""
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_valid().to_numpy(zero_copy_only=False)


def _among(column: pa.Array, values: tuple[str, ...]) -> np.ndarray:
    return pc.is_in(column, pa.array(values, column.type)).to_numpy(zero_copy_only=False)


def _key(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (doc << 32) + (place + (1 << 31))


def _spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number of every span, with the span's own number."""
    n = np.maximum(high - low, 0)
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + low[at]


def _matches(wanted: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places where ``wanted`` equals the sorted ``keys``."""
    return _spans(np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right"))


class Tokens:
    """A batch's tokens by document and place; ``up`` is a token's head, -1 where it ends a path."""

    def __init__(self, rows: pa.RecordBatch):
        lists = rows.column(1)
        sizes, fields = _sizes(lists), _fields(lists)
        doc, (place, fine) = np.repeat(np.arange(rows.num_rows), sizes), _numbers(fields["i"])
        key = _key(doc, place)
        order = np.argsort(key, kind="stable")
        order = order[fine[order]]
        self.n, self.doc, self.key, self.place = len(order), doc[order], key[order], place[order]
        self.columns = {name: column.take(pa.array(order)) for name, column in fields.items()}
        self.rows = rows

    def find(self, doc: np.ndarray, place: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Number of the token at a document's place, -1 where there is none."""
        key = _key(doc, place)
        at = np.minimum(np.searchsorted(self.key, key), max(self.n - 1, 0))
        return np.where(known & (self.key[at] == key), at, -1) if self.n else np.full(len(key), -1)

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        head, known = _numbers(self.columns["head"])
        link = self.find(self.doc, head, known)
        up = np.where(link == np.arange(self.n), -1, link)
        far, rounds = np.append(np.where(up < 0, self.n, up), self.n), 0
        while (far != self.n).any():
            far, rounds = far[far], rounds + 1
            if rounds > max(self.n, 2).bit_length() + 1:
                raise ValueError("tokens' heads form a circle")
        return link, up

    def ids(self, doc: np.ndarray) -> pa.Array:
        return self.rows.column(0).take(pa.array(doc))

    def take(self, name: str, at: np.ndarray, where: np.ndarray | None = None) -> pa.Array:
        return self.columns[name].take(pa.array(at, mask=None if where is None else ~where))


def _entities(t: Tokens) -> tuple[dict[str, pa.Array], np.ndarray, np.ndarray, np.ndarray]:
    """Fields, documents, first and last places of the entities that have both."""
    lists = t.rows.column(2)
    fields, doc = _fields(lists), np.repeat(np.arange(t.rows.num_rows), _sizes(lists))
    (start, one), (stop, two) = _numbers(fields["start"]), _numbers(fields["stop"])
    held = np.flatnonzero(one & two)
    return {n: c.take(pa.array(held)) for n, c in fields.items()}, doc[held], start[held], stop[held]


def _joined(strings: pa.Array, group: np.ndarray, n: int) -> pa.Array:
    """The strings of each of n groups (``group`` rises) joined by spaces, nulls left out."""
    fine = strings.is_valid().to_numpy(zero_copy_only=False)
    offsets = np.searchsorted(group[fine], np.arange(n + 1))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), strings.drop_null()), " ")


def _arguments(t: Tokens, up: np.ndarray, asked: np.ndarray, leading: tuple[str, ...]) -> tuple[pa.Array, pa.Array]:
    """Argument and label of each asked token: the first entity that covers it, else its phrase."""
    order = np.argsort(up, kind="stable")
    below, keys = order[up[order] >= 0], np.sort(up[up >= 0])
    root, node = np.arange(len(asked)), asked
    roots, nodes = [root], [node]
    while len(node):
        at, hit = _matches(node, keys)
        root, node = root[at], below[hit]
        roots.append(root)
        nodes.append(node)
    root, node = np.concatenate(roots), np.concatenate(nodes)
    order = np.lexsort((node, root))
    root, node = root[order], node[order]
    pos, dep = t.columns["pos"], t.columns["dep"]
    fine = (pos.is_valid().to_numpy(zero_copy_only=False) & ~_among(pos, ("PUNCT", "SPACE")))[node]
    begins = fine & (dep.is_valid().to_numpy(zero_copy_only=False) & ~_among(dep, leading))[node]
    first = np.full(len(asked), t.n)
    np.minimum.at(first, root[begins], node[begins])
    text = t.columns["text"].take(pa.array(node))
    clean = fine & (node >= first[root])
    phrase = _joined(text.filter(pa.array(clean)), root[clean], len(asked))
    argument = pc.if_else(pc.equal(phrase, ""), _joined(text, root, len(asked)), phrase)
    fields, doc, start, stop = _entities(t)
    which, token = _spans(np.searchsorted(t.key, _key(doc, start)), np.searchsorted(t.key, _key(doc, stop)))
    order = np.lexsort((which, start[which], token))
    token, at = np.unique(token[order], return_index=True)
    found = np.full(t.n, -1)
    found[token] = which[order][at]
    found = found[asked]
    of = pa.array(found, mask=found < 0)
    return pc.coalesce(fields["entity"].take(of), argument), pc.coalesce(fields["label"].take(of), "")


def triples(subjects: tuple[str, ...], complements: tuple[str, ...], leading: tuple[str, ...]) -> Callable:
    """Subject, verb and complement of each verb, with the complement's first case mark."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts(batches):
            t = Tokens(rows)
            link, up = t.heads()
            dep, verb = t.columns["dep"], _among(t.columns["pos"], ("VERB", "AUX"))

            def under(labels: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
                held = np.flatnonzero(_among(dep, labels) & (link >= 0))
                held = held[np.argsort(link[held], kind="stable")]
                return held, link[held]

            (subject, its), (complement, of), (case, marked) = under(subjects), under(complements), under(("case",))
            own = verb[its]
            has = np.zeros(t.n, bool)
            has[its] = True
            bare = np.flatnonzero(verb & _among(dep, ("conj",)) & ~has & (link >= 0))
            bare = bare[verb[link[bare]]]
            at, hit = _matches(link[bare], its)  # a joined verb takes the subjects of the one before
            v, s = np.concatenate([its[own], bare[at]]), np.concatenate([subject[own], subject[hit]])
            at, hit = _matches(v, of)
            v, s, o = v[at], s[at], complement[hit]
            asked, place = np.unique(np.concatenate([s, o]), return_inverse=True)
            argument, label = _arguments(t, up, asked, leading)
            a, b = pa.array(place[: len(s)]), pa.array(place[len(s) :])
            marked, first = np.unique(marked, return_index=True)
            mark = np.full(t.n, -1)
            mark[marked] = case[first]
            mark = mark[o]
            yield pa.RecordBatch.from_arrays(
                [
                    t.ids(t.doc[v]), t.take("sent", v), argument.take(a), label.take(a), argument.take(b), label.take(b),
                    t.take("lemma", v), t.take("dep", o), t.take("text", mark, mark >= 0), t.take("lemma", mark, mark >= 0),
                ],
                names=["doc_id", "sent", "subject", "subject_label", "object", "object_label", "lemma", "dependency", "case_text", "case_lemma"],
            )

    return run


def sentences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, sent, start, stop, sentence``."""
    for rows in parts(batches):
        t = Tokens(rows)
        sent, known = _numbers(t.columns["sent"])
        key = np.where(known, _key(t.doc, sent), (t.doc << 32) - 1)  # a null number is a sentence of its own
        order = np.argsort(key, kind="stable")
        _, first, group, n = np.unique(key[order], return_index=True, return_inverse=True, return_counts=True)
        head, last = order[first], order[first + n - 1]
        held = _joined(t.take("text", order), group, len(first))
        yield pa.RecordBatch.from_arrays(
            [t.ids(t.doc[head]), t.take("sent", head), pa.array(t.place[head], pa.int32()), pa.array(t.place[last] + 1, pa.int32()), held],
            names=["doc_id", "sent", "start", "stop", "sentence"],
        )


def mentions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, sent, label, entity, start`` of entities that begin at a token."""
    for rows in parts(batches):
        t = Tokens(rows)
        fields, doc, start, _ = _entities(t)
        at = t.find(doc, start, np.ones(len(doc), bool))
        held = np.flatnonzero(at >= 0)
        of = pa.array(held)
        yield pa.RecordBatch.from_arrays(
            [t.ids(doc[held]), t.take("sent", at[held]), fields["label"].take(of), fields["entity"].take(of), fields["start"].take(of)],
            names=["doc_id", "sent", "label", "entity", "start"],
        )


def best(k: int) -> Callable:
    """The k best items of each group of counted ones (``g, item, n, at``), once for every MOST_ITEMS rows.

    The first of a group's rows has the sum of ``n`` and the number of all its items, the others 0.
    """

    def ranked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().sort_by([("g", "ascending"), ("n", "descending"), ("at", "ascending"), ("item", "ascending")])
        names = rows["g"].combine_chunks()
        code = pc.fill_null(names.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        size = np.diff(np.append(first, len(code)))
        rank = np.arange(len(code)) - np.repeat(first, size)
        mentions, items = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        mentions[first], items[first] = np.add.reduceat(rows["n"].to_numpy(), first), size
        rows = rows.append_column("mentions", pa.array(mentions)).append_column("distinct_items", pa.array(items))
        return rows.filter(pa.array(rank < k)).combine_chunks().to_batches()[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for rows in batches:
            if rows.num_rows:
                held, n = [*held, rows], n + rows.num_rows
            if n >= MOST_ITEMS:
                yield ranked(held)
                held, n = [], 0
        if held:
            yield ranked(held)

    return run
