"""Streams of documents into the store: each micro-batch appends places and bands under a fixed model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from twinsift.config import Mode
from twinsift.operators import docfreq
from twinsift.plans.engine import bands_of, features_of, items_of, nodes_of
from twinsift.sources import files as sources
from twinsift.sources.store import Store


def ingest(documents: DataFrame, store: Store, mode: Mode, checkpoint: str) -> StreamingQuery:
    """Run over a streaming ``documents`` (doc_id, text, lang, source) until what is available is in the store.

    Document frequencies stay those of the store; contents whose bands are in it already are left out.  A batch
    is one job of the store under its own number: one that is repeated after a failure counts once.
    """

    def add(batch: DataFrame, number: int) -> None:
        with store.job(f"{checkpoint}#{number}") as job:
            if job.repeated:
                return
            files = sources.readable(sources.from_documents(batch))
            job.save_meta(sources.meta(files))
            model = store.docfreq(mode.name)
            if model is None:
                raise RuntimeError("the store has no document frequencies yet: hash a first collection")
            nodes = nodes_of(files, mode)
            items = items_of(files, mode, nodes)
            # Every item has a band in every table: the first tells what is known.
            new = items.join(store.bands(mode.name).where("hashtable = 0").select("doc"), "doc", "left_anti")
            job.save_bands(bands_of(docfreq.bags(features_of(new, mode, nodes).join(new.select("doc"), "doc", "left_semi"), model[1], model[0]), mode), mode.name)

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
