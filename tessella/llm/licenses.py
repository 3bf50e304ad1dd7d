"""License scans by diagonal voting.

The hashes of all rolling word grams of every text are joined in Spark to the places of the same grams in the templates:
grams of two words for the base phrases, of GRAM words for notices and whole licenses. A match votes for its diagonal (place in the text less place in the template); votes are gathered by diagonal,
diagonals close together are merged, so a few words more or less do not break a match, and the voted words of each
span are compared with the template's.

Defined cases: a null or empty text has no words, no labels and score 0; texts of one word have no grams; repeated
rows get the same result each; a null doc_id is an id like any other; an empty table gives an empty result. Only
doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.license_texts import TEXTS
from tessella.llm.textbits import Rolling, binaries, chunks, letter_words, mix, modest_batches, ragged, tidy, word_hashes

NO_ID = -(2**63)
CHUNK = 4_000_000
#: Words of a gram of the base phrases, and of a gram of all other templates.
SHORT, GRAM = 2, 4
#: Rows of the templates' grams that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Phrases that count wherever they stand, with their labels: fixed values.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Opening sentences of common licenses, as published, with the labels that the method adds: fixed values.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-text"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-text"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-text"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc-text"),
    ("this is free and unencumbered software released into the public domain", "unlicense-text"),
]


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every text its grams of SHORT words, then those of GRAM words: hashes, places, and how many each text has."""
    buf, starts, lens, counts = letter_words(texts)
    rolling = Rolling(word_hashes(buf, starts, lens, 7), 7)
    first, hashes, places, owners = np.cumsum(counts) - counts, [], [], []
    for k in (SHORT, GRAM):
        have = np.maximum(counts - k + 1, 0)
        at = ragged(first, have)
        owner = np.repeat(np.arange(len(texts)), have)
        hashes.append(mix(rolling.windows(k)[at] + np.uint64(k)))
        places.append(at - first[owner])
        owners.append(owner)
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(hashes)[order], np.concatenate(places)[order], np.bincount(np.concatenate(owners), minlength=len(texts))


def _gram(template: tuple[list[bytes], str, bool]) -> int:
    return SHORT if template[2] else GRAM


def all_templates(templates: list[tuple[str, str]]) -> list[tuple[list[bytes], str, bool]]:
    """Words, label and whether it is a base phrase; the base phrases first. A template shorter than a gram is none."""

    def words(text: str) -> list[bytes]:
        buf, starts, lens, _ = letter_words([text.encode()])
        return [buf[s : s + n] for s, n in zip(starts.tolist(), lens.tolist(), strict=True)]

    rows = [(words(t), label, base) for listed, base in ((BASE, True), (templates, False)) for t, label in listed]
    return [r for r in rows if len(r[0]) >= _gram(r)]


def diagonal_votes(docs: DataFrame, share: float, templates: list[tuple[list[bytes], str, bool]]) -> DataFrame:
    """id, tag, may: per document the templates with enough voted grams, each with its diagonals' voted places."""
    rows, need = [], []
    for number, template in enumerate(templates):
        words, _, base = template
        hashes, places, _ = _grams([b" ".join(words)])
        own = len(words) - SHORT + 1
        picked = slice(0, own) if base else slice(own, None)
        rows += [(h, number, p) for h, p in zip(hashes[picked].view(np.int64).tolist(), places[picked].tolist(), strict=True)]
        n = len(words) - _gram(template) + 1
        need.append((number, n if base else int(np.ceil(share * n))))

    @tidy
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binaries(batch.column(2))
            for a, b in chunks(texts, CHUNK):
                grams, places, counts = _grams(texts[a:b])
                each = pa.StructArray.from_arrays([pa.array(grams.view(np.int64)), pa.array(places, pa.int32())], ["gram", "pos"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), each)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], ["id", "tag", "grams"])

    spark = docs.sparkSession
    sent = F.broadcast if len(rows) <= BROADCAST_ROWS else lambda df: df
    places, needs = (sent(spark.createDataFrame(*x)) for x in ((rows, "gram bigint, template int, place int"), (need, "template int, need int")))
    grams = docs.select("id", "tag", "text").mapInArrow(hashed, "id bigint, tag bigint, grams array<struct<gram bigint, pos int>>")
    met = grams.select("id", "tag", F.explode("grams").alias("g")).select("id", "tag", "g.gram", "g.pos").join(places, "gram")
    diagonals = met.groupBy("id", "tag", "template", (F.col("pos") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))
    per_template = diagonals.groupBy("id", "tag", "template").agg(F.collect_list(F.struct("diagonal", "places")).alias("diagonals")).join(needs, "template")
    voted = F.size(F.array_distinct(F.flatten(F.transform("diagonals", lambda d: d["places"]))))
    return per_template.where(voted >= F.col("need")).groupBy("id", "tag").agg(F.collect_list(F.struct("template", "diagonals")).alias("may"))


def merged(diagonals: list[tuple[int, list[int]]], gap: int) -> list[list[tuple[int, int]]]:
    """Diagonals less than gap apart in one group, each as (diagonal, place) votes."""
    out: list[list[tuple[int, int]]] = []
    last = None
    for diagonal, places in sorted(diagonals):
        if last is None or diagonal - last > gap:
            out.append([])
        out[-1] += [(diagonal, p) for p in sorted(places)]
        last = diagonal
    return out


def spans_of(words: list[bytes], may: list[tuple[int, list[tuple[int, list[int]]]]], share: float, gap: int, templates: list[tuple[list[bytes], str, bool]]) -> list[tuple[int, int, int, float]]:
    """Verified spans (template, first word, words, share of the template's grams) of one text."""
    out = []
    for number, diagonals in may:
        template, _, base = templates[number]
        if base:
            out += [(number, d, len(template), 1.0) for d, _ in diagonals if d >= 0 and words[d : d + len(template)] == template]
            continue
        for votes in merged(diagonals, gap):
            real = sorted((d + p, p) for d, p in votes if words[d + p : d + p + GRAM] == template[p : p + GRAM])
            covered = len({p for _, p in real}) / (len(template) - GRAM + 1)
            if real and covered >= share:
                first, end = real[0][0], real[-1][0] + GRAM
                if end - first <= 2 * len(template):
                    out.append((number, first, end - first, covered))
    return sorted(out, key=lambda s: (s[1], s[0]))


def scan_licenses(docs: DataFrame, *, templates: list[tuple[str, str]] | None = None, share: float = 0.6, gap: int = 3) -> DataFrame:
    """Rows doc_id, n_words, spans: all verified spans (label, base, first, n, share), base phrases at every place.

    templates: texts and labels beside the base phrases, else the notices and whole licenses. A label needs that share
    of its template's grams on diagonals at most `gap` apart.
    """
    modest_batches(docs.sparkSession)
    templates = all_templates([*NOTICES, *TEXTS] if templates is None else templates)
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("tag"))
    found = diagonal_votes(keyed, share, templates).withColumnsRenamed({"id": "found_id", "tag": "found_tag"})
    joined = keyed.join(found, (F.col("id") == F.col("found_id")) & (F.col("tag") == F.col("found_tag")), "left").select(F.col("doc_id").cast("bigint"), "text", "may")
    span = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("n", pa.int64()), ("share", pa.float64())])

    @tidy
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, may = binaries(batch.column(1)), batch.column(2)
            for a, b in chunks(texts, CHUNK):
                buf, starts, lens, counts = letter_words(texts[a:b])
                heads, spans = np.cumsum(counts) - counts, []
                for head, count, m in zip(heads.tolist(), counts.tolist(), may.slice(a, b - a).to_pylist(), strict=True):
                    words = [buf[s : s + n] for s, n in zip(starts[head : head + count].tolist(), lens[head : head + count].tolist(), strict=True)] if m else []
                    rows = spans_of(words, [(t["template"], [(d["diagonal"], d["places"]) for d in t["diagonals"]]) for t in m or ()], share, gap, templates)
                    spans.append([{"label": templates[t][1], "base": templates[t][2], "first": f, "n": n, "share": s} for t, f, n, s in rows])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(span))], ["doc_id", "n_words", "spans"])

    return joined.mapInArrow(verify, "doc_id bigint, n_words bigint, spans array<struct<label string, base boolean, first bigint, n bigint, share double>>")
