"""All registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from corvane.plans import answers, corpus, extras, retrieval, stores, streams, texts, tools

QUERIES: dict = {**retrieval.QUERIES, **texts.QUERIES, **corpus.QUERIES, **extras.QUERIES, **tools.QUERIES, **stores.QUERIES, **streams.QUERIES, **answers.QUERIES}
ORACLES: dict = {**retrieval.ORACLES, **texts.ORACLES, **corpus.ORACLES, **extras.ORACLES, **tools.ORACLES, **stores.ORACLES, **streams.ORACLES, **answers.ORACLES}
