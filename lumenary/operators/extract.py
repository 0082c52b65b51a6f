"""Entity mentions and subject-relation-object triples over a table of parsed tokens.

Tokens come from any parser as rows ``doc_id, sent, i, head, dep, pos, lemma, text`` (``i`` and
``head`` are places in the document), entities as ``doc_id, start, stop, label, entity``, or both
as lists in a row for each document. The rules stay inside a document (``parse_rows``), so a corpus
is one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenary.operators import parse_rows
from lumenary.session import ship, written

# Dependency labels, pronouns that are no argument, contracted prepositions.
SUBJECTS, COMPLEMENTS, LEADING = ("nsubj", "nsubj:pass"), ("obj", "iobj", "obl"), ("case", "det")
PRONOUNS = ("que", "qual", "quais", "quem", "onde", "quando", "como")
PREPOSITIONS = {
    "no": "em", "na": "em", "nos": "em", "nas": "em", "do": "de", "da": "de", "dos": "de", "das": "de",
    "ao": "a", "aos": "a", "à": "a", "às": "a", "pelo": "por", "pela": "por", "pelos": "por", "pelas": "por",
}


def preposition(word: Column, lemma: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in PREPOSITIONS.items() for x in pair])
    return F.coalesce(known[F.lower(word)], F.lower(lemma))


def subtrees(tokens: DataFrame) -> DataFrame:
    """``doc_id, root, i`` for every token at or below every other, however deep.

    Paths of doubled length are joined until none is new, so a tree of depth d takes log d rounds;
    each is written to the checkpoint folder where there is one. A token that is its own head, or
    whose head is missing, ends a path; heads in a circle are an error.
    """
    edges = tokens.filter("i <> head").select("doc_id", F.col("head").alias("root"), "i")
    reached = tokens.select("doc_id", F.col("i").alias("root"), "i")
    step = edges  # pairs that are exactly one edge apart, then two, four and so on
    while not step.isEmpty():
        # what is less than that below the end of such a pair is less than twice as far below its start
        far = step.withColumnRenamed("i", "mid").join(reached.withColumnRenamed("root", "mid"), ["doc_id", "mid"]).select("doc_id", "root", "i")
        far = written(far)
        if not far.filter("root = i").isEmpty():
            raise ValueError("tokens' heads form a circle")
        reached = reached.unionByName(far)
        next_step = step.withColumnRenamed("i", "mid").join(step.withColumnRenamed("root", "mid"), ["doc_id", "mid"]).select("doc_id", "root", "i")
        step = written(next_step)
    return reached


def gathered(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """Token and entity tables as a row for each document that has tokens: ``doc_id, tokens, entities``."""
    listed = lambda df, names: df.groupBy("doc_id").agg(F.collect_list(F.struct(*[F.col(n).cast(kind).alias(n) for n, kind in names.items()])).alias("l"))
    of = listed(entities, _ENTITY).withColumnRenamed("l", "entities")
    return listed(tokens, _TOKEN).withColumnRenamed("l", "tokens").join(of, "doc_id", "left")


Batches = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _mapped(rows: DataFrame, run: Batches, shape: str, parse: Batches | None) -> DataFrame:
    ship(rows.sparkSession)
    both = run if parse is None else lambda batches: run(parse(batches))
    return rows.select("doc_id", *[c for c in rows.columns if c != "doc_id"]).mapInArrow(both, f"doc_id {dict(rows.dtypes)['doc_id']}, {shape}")


def triples(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """``doc_id, sent, subject, subject_label, relation, object, object_label, verb, dependency``.

    Documents are gathered in one exchange; where a parser gives whole documents, ``triples_of``
    needs none.
    """
    return triples_of(gathered(tokens, entities))


def triples_of(rows: DataFrame, parse: Batches | None = None) -> DataFrame:
    """Triples of documents (``doc_id, tokens, entities``), each from its own row.

    ``parse`` makes such rows in the same task from other columns, ``doc_id`` first, so that
    tokens need not pass through the engine.

    A verb's subjects are its own; a coordinated verb without any takes those of the verb it is
    joined to. An oblique complement adds its preposition to the relation. An argument is the
    entity that holds the token, else its phrase: the token's subtree in order without punctuation
    and leading case marks and determiners; where nothing is left, the whole span of the subtree.
    """
    shape = (
        "sent int, subject string, subject_label string, object string, object_label string, "
        "lemma string, dependency string, case_text string, case_lemma string"
    )
    found = _mapped(rows, parse_rows.triples(SUBJECTS, COMPLEMENTS, LEADING), shape, parse)
    found = found.withColumn("verb", F.lower("lemma")).withColumn("prep", preposition(F.col("case_text"), F.col("case_lemma")))
    relation = F.when((F.col("dependency") == "obl") & F.col("prep").isNotNull(), F.concat_ws("_", "verb", "prep")).otherwise(F.col("verb"))
    valid = lambda c: (F.col(c) != "") & ~F.lower(c).isin(*PRONOUNS)
    return found.withColumn("relation", relation).filter(valid("subject") & valid("object")).select(
        "doc_id", "sent", "subject", "subject_label", "relation", "object", "object_label", "verb", "dependency"
    )


#: Schema of parsed tokens and of entities.
TOKENS = "doc_id long, sent int, i int, head int, dep string, pos string, lemma string, text string"
ENTITIES = "doc_id long, start int, stop int, label string, entity string"
_TOKEN, _ENTITY = (dict(x.split() for x in shape.split(", ")[1:]) for shape in (TOKENS, ENTITIES))

Parser = Callable[[list[str]], list[tuple[list[tuple], list[tuple]]]]


def parsed(docs: DataFrame, make: Callable[[], Parser], text_col: str = "text", batch: int = 16) -> tuple[DataFrame, DataFrame]:
    """Token and entity tables of documents, from ``parsed_rows``."""
    both = parsed_rows(docs, make, text_col, batch)
    return both.select("doc_id", F.inline("tokens")), both.select("doc_id", F.inline("entities"))


def parsed_rows(docs: DataFrame, make: Callable[[], Parser], text_col: str = "text", batch: int = 16) -> DataFrame:
    """``doc_id, tokens, entities`` of documents, by a parser from outside.

    ``make`` is called once in each task and gives a function from a few texts to, for each,
    tokens ``(sent, i, head, dep, pos, lemma, text)`` and entities ``(start, stop, label, entity)``.
    A null text is empty. Whatever is made of it comes from one parse, which is written to the
    checkpoint folder where there is one.
    """

    shape = T.StructType.fromDDL(_PARSED)
    arrow = to_arrow_schema(shape)
    names = [[f.name for f in shape[k].dataType.elementType] for k in ("tokens", "entities")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = make()
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                found = parse([x or "" for x in part.column(1).to_pylist()])
                lists = [[[dict(zip(names[k], item)) for item in both[k]] for both in found] for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, arrow.field(k + 1).type) for k, x in enumerate(lists))], schema=arrow)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col).mapInArrow(run, _PARSED))


_PARSED = (
    "doc_id long, tokens array<struct<sent:int,i:int,head:int,dep:string,pos:string,lemma:string,text:string>>, "
    "entities array<struct<start:int,stop:int,label:string,entity:string>>"
)


def sentences(tokens: DataFrame) -> DataFrame:
    """``doc_id, sent, start, stop, sentence``: places and text of each sentence."""
    held = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " ")
    return tokens.groupBy("doc_id", "sent").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop"), held.alias("sentence"))


def sentences_of(rows: DataFrame, parse: Batches | None = None) -> DataFrame:
    """Places and text of each sentence of documents (``doc_id, tokens, entities``), each from its own row."""
    return _mapped(rows, parse_rows.sentences, "sent int, start int, stop int, sentence string", parse)


def mentions(tokens: DataFrame, entities: DataFrame, shortest: int = 2) -> DataFrame:
    """``doc_id, sent, label, entity, start``: entities with the sentence that they begin in, short ones left out."""
    at = tokens.select("doc_id", F.col("i").alias("start"), "sent")
    return _clean(entities.join(at, ["doc_id", "start"]), shortest)


def mentions_of(rows: DataFrame, parse: Batches | None = None, shortest: int = 2) -> DataFrame:
    """Mentions of documents (``doc_id, tokens, entities``), each from its own row."""
    return _clean(_mapped(rows, parse_rows.mentions, "sent int, label string, entity string, start int", parse), shortest)


def _clean(found: DataFrame, shortest: int) -> DataFrame:
    clean = F.trim(F.regexp_replace("entity", r"\s+", " "))
    return found.select("doc_id", "sent", "label", clean.alias("entity"), "start").filter(F.length("entity") >= shortest)


def extracted(docs: DataFrame, make: Callable[[], Parser], text_col: str = "text", batch: int = 16) -> tuple[DataFrame, DataFrame]:
    """Mentions and triples of documents, from one parse."""
    rows = parsed_rows(docs, make, text_col, batch)
    return mentions_of(rows), triples_of(rows)


def rollup(rows: DataFrame, group: str, item: Column, k: int, order: list[str]) -> DataFrame:
    """Mentions, distinct items and the k most frequent of each group, first seen first on ties.

    ``order``: an integer id and an int place in it. Items are counted in one exchange; each task
    then keeps the k best of every group beside its sums, so that the second exchange has no more
    of a frequent group than that. The first place is one number, as a struct would have every
    task sort its rows before it counts them.
    """
    whole, part = order
    at = F.coalesce(F.col(whole).cast("decimal(19,0)"), F.lit(-(1 << 63)).cast("decimal(19,0)")) * F.lit(1 << 32).cast("decimal(10,0)")
    at = at + F.coalesce(F.col(part).cast("int"), F.lit(-(1 << 31)).cast("int")).cast("decimal(10,0)")
    named = rows.select(F.col(group).alias("g"), item.alias("item"), at.cast("decimal(38,0)").alias("at"))
    counted = named.groupBy("g", "item").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)[group]
    best = counted.mapInArrow(parse_rows.best(k), f"g {kind}, item string, n long, at decimal(38,0), mentions long, distinct_items long")
    # one exchange by group serves the sums and the ranks
    same = Window.partitionBy("g")
    best = best.withColumns({"mentions": F.sum("mentions").over(same), "distinct_items": F.sum("distinct_items").over(same)})
    ranked = best.withColumn("k", F.row_number().over(same.orderBy(F.desc("n"), "at", "item"))).filter(F.col("k") <= k)
    held = F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(": ", "item", F.col("n").cast("string")).alias("s")))), lambda x: x["s"])
    found = ranked.groupBy("g").agg(F.first("mentions").alias("mentions"), F.first("distinct_items").alias("distinct_items"), F.array_join(held, "; ").alias("top"))
    return found.select(F.col("g").alias(group), "mentions", "distinct_items", "top")
