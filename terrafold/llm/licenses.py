"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, table

# Licences by SPDX identifier and how notices name them. Words in capitals, and those with a digit, must occur.
NAMES = {
    "MIT": ["MIT LICENSE"],
    "Apache-2.0": ["APACHE license version 2.0", "APACHE license 2.0", "APACHE software license version 2.0"],
    "GPL-2.0": ["gnu GENERAL PUBLIC license version 2", "gnu GPL version 2", "gnu GPL 2.0", "GPLV2"],
    "GPL-3.0": ["gnu GENERAL PUBLIC license version 3", "gnu GPL version 3", "gnu GPL 3.0", "GPLV3"],
    "LGPL-2.1": ["gnu LESSER general public license version 2.1", "gnu LGPL version 2.1"],
    "LGPL-3.0": ["gnu LESSER general public license version 3", "gnu LGPL version 3"],
    "AGPL-3.0": ["gnu AFFERO general public license version 3", "gnu AGPL version 3"],
    "BSD-2-Clause": ["BSD 2 clause LICENSE"],
    "BSD-3-Clause": ["BSD 3 clause LICENSE"],
    "MPL-2.0": ["MOZILLA public license version 2.0", "MOZILLA public license 2.0"],
    "ISC": ["ISC LICENSE"],
    "Unlicense": ["UNLICENSE"],
    "EPL-2.0": ["ECLIPSE public license version 2.0", "ECLIPSE public license 2.0"],
    "BSL-1.0": ["BOOST software license version 1.0", "BOOST software license 1.0"],
    "Zlib": ["ZLIB LICENSE"],
    "CC0-1.0": ["CC0 1.0 universal", "creative commons CC0 1.0 universal public domain dedication"],
}
COMMONS = {"BY": "ATTRIBUTION", "SA": "SHAREALIKE", "NC": "NONCOMMERCIAL", "ND": "NODERIVATIVES"}
COMMONS_KINDS, COMMONS_VERSIONS = ["BY", "BY SA", "BY NC", "BY ND", "BY NC SA", "BY NC ND"], ["3.0", "4.0"]
LEADS = ["{}", "licensed under {}", "licensed under the {}", "this work is licensed under a {}", "released under the {}", "this work is licensed under the {}", "distributed under the terms of the {}", "licensed under the {} see the license file for details"]
# Longer notices and texts of licences.
NOTICES = [
    ("Apache-2.0", "licensed under the APACHE license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0"),
    ("Apache-2.0", "APACHE license version 2.0 january 2004 http www apache org licenses"),
    ("GPL-3.0", "gnu GENERAL PUBLIC license version 3 29 june 2007 copyright c 2007 free software foundation inc"),
    ("GPL-2.0", "gnu GENERAL PUBLIC license version 2 june 1991 copyright c 1989 1991 free software foundation inc"),
    ("LGPL-3.0", "gnu LESSER general public license version 3 29 june 2007 copyright c 2007 free software foundation inc"),
    ("AGPL-3.0", "gnu AFFERO general public license version 3 19 november 2007 copyright c 2007 free software foundation inc"),
    ("MPL-2.0", "this source code form is subject to the terms of the MOZILLA public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0"),
    ("MPL-2.0", "this source code form is subject to the terms of the MOZILLA public license v 2.0"),
    ("MIT OR Apache-2.0", "licensed under either of APACHE license version 2.0 or MIT license"),
    ("MIT OR Apache-2.0", "dual licensed under MIT and APACHE 2.0"),
    ("Zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software PERMISSION is GRANTED to ANYONE to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("Unlicense", "this is free and UNENCUMBERED software released into the public domain"),
    ("CC0-1.0", "released into the public domain under CC0"),
    ("Proprietary", "ALL RIGHTS RESERVED"),
    ("Proprietary", "copyright c ALL RIGHTS RESERVED"),
    ("MIT", "PERMISSION is hereby GRANTED free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "PERMISSION is hereby GRANTED free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("ISC", "PERMISSION to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSD-2-Clause", "REDISTRIBUTION and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "REDISTRIBUTION and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BSD-3-Clause", "REDISTRIBUTION and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution NEITHER the name of the copyright holder nor the names of its contributors may be used to ENDORSE or promote products derived from this software without specific prior written permission"),
]
GNU = {"GPL": "GENERAL PUBLIC", "LGPL": "LESSER general public", "AGPL": "AFFERO general public"}
GNU_NOTICE = "this program is free software you can REDISTRIBUTE it and or modify it under the terms of the gnu {} license as published by the free software foundation either version {} of the license or at your option any later version"

TOKEN = r"[A-Za-z0-9]+(?:\.[0-9]+)*"
#: What parts a text into pieces: ends of lines and sentences.
PIECE_END = r"[.!?;][ \t\r\n]+|\n"
#: From each piece on that holds a key word, runs grow piece by piece until they have so many times the words of the longest template,
#: however short the lines are.
RUN_SIZES = 2
LICENSE_NAME = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)([-._][^/]*)?$"
THRESHOLD = 0.6
#: Of runs that come so near to the best score, the one of the longest template counts: a licence holds the words of shorter ones.
NEAR = 0.05


def templates() -> list[tuple[str, list[str], set[str]]]:
    """(licence, tokens, tokens that must occur) of each template."""
    said = []
    for spdx, names in NAMES.items():
        said += [(spdx, lead.format(name)) for name in names for lead in LEADS if lead != "{}" or len(name.split()) > 2 or spdx in ("ISC", "Unlicense") or name.startswith("GPLV")]
        tag = f"SPDX license identifier {' '.join(re.findall(TOKEN, spdx)).upper()}"
        said += [(spdx, f"{tag}{more}") for more in (("", " only", " or later") if "GPL" in spdx else ("",))]
    for kind in COMMONS_KINDS:
        for version in COMMONS_VERSIONS:
            spdx, long = f"CC-{kind.replace(' ', '-')}-{version}", " ".join(COMMONS[x] for x in kind.split())
            said += [(spdx, lead.format(name)) for name in (f"CC {kind} {version}", f"creative commons {long} {version} international license") for lead in LEADS]
            said += [(spdx, f"SPDX license identifier CC {kind} {version}")]
    for family, words in GNU.items():
        said += [(spdx, GNU_NOTICE.format(words, spdx.split("-")[1].removesuffix(".0"))) for spdx in NAMES if spdx.split("-")[0] == family]
    out = []
    for spdx, text in said + NOTICES:
        tokens = re.findall(TOKEN, text)
        out.append((spdx, [t.lower() for t in tokens], {t.lower() for t in tokens if t.isupper() or t.replace(".", "").isdigit()}))
    return out


class Templates:
    """TF-IDF vectors of the templates, the words they know, and key words, one that each template needs: a text without any has no
    licence.

    Inverse document frequencies are over the templates; a word of none of them has the highest, and each of its occurrences is a
    dimension of its own.
    """

    def __init__(self):
        found = templates()
        n, df = len(found), Counter(t for _, bag, _ in found for t in set(bag))
        self.licenses, self.sizes = [spdx for spdx, _, _ in found], [len(bag) for _, bag, _ in found]
        self.words = {t: k for k, t in enumerate(sorted(df))}
        self.idf = np.array([math.log((1 + n) / (1 + df[t])) + 1 for t in sorted(df)])
        self.rare = math.log(1 + n) + 1
        self.weights, self.needed = np.zeros((n, len(df))), np.zeros((n, len(df)), bool)
        keys = set()
        for k, (_, bag, must) in enumerate(found):
            for t, c in Counter(bag).items():
                self.weights[k, self.words[t]] = c * self.idf[self.words[t]]
            self.weights[k] /= np.linalg.norm(self.weights[k])
            self.needed[k, [self.words[t] for t in must]] = True
            keys.add(max((t for t in bag if t in must and not t[0].isdigit()), key=len))
        self.n_needed, self.run_words = self.needed.sum(axis=1), RUN_SIZES * max(self.sizes)
        self.musts = {frozenset(must) for _, _, must in found}
        self.keys = keys

    def scores(self, which: np.ndarray, tf: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Cosines with every template, rounded to six digits, for rows of counts of the known words ``which`` and of other words; 0 where
        a needed word is missing."""
        x = tf * self.idf[which]
        norm = np.sqrt((x * x).sum(axis=1) + others * self.rare**2)
        scores = np.round((x @ self.weights[:, which].T) / np.maximum(norm, 1e-9)[:, None], 6)
        had = (tf > 0).astype(np.float64) @ self.needed[:, which].T.astype(np.float64)
        scores[had < self.n_needed] = 0.0
        return scores

    def score(self, text: str | None, whole: bool) -> tuple[float, int, int, int] | None:
        """(score, template, first piece, pieces) of the best run of a text: the longest template within NEAR of the highest score, then
        the score, the first template, the first and the shortest run; for ``whole`` its whole text is one more run, (-1, -1). None
        below the threshold."""
        lowered = [t.lower() for t in re.findall(TOKEN, text or "")]
        if self.keys.isdisjoint(lowered):
            return None
        said = set(lowered)
        if not any(must <= said for must in self.musts):
            return None
        pieces = [[t.lower() for t in re.findall(TOKEN, p)] for p in re.split(PIECE_END, text)]
        found = []
        for h in (k for k, p in enumerate(pieces) if not self.keys.isdisjoint(p)):
            found += self._of_runs(pieces, h)
        if whole:
            found += self._scored([lowered], [(-1, -1)])
        most = max((s for s, _, _ in found), default=0.0)
        best = min(((-self.sizes[k], -s, k, *run) for s, k, run in found if s >= round(most - NEAR, 6)), default=None)
        return best and (-best[1], *best[2:])

    def _of_runs(self, pieces: list[list[str]], first: int) -> list[tuple[float, int, tuple[int, int]]]:
        """`_scored` of the runs that begin at a piece. Pieces without a word end no run: the shorter one says the same."""
        some, runs, n = [], [], 0
        for k in range(first, len(pieces)):
            if n >= self.run_words:
                break
            if pieces[k]:
                some.append(pieces[k])
                runs.append((first, k - first + 1))
                n += len(pieces[k])
        return self._scored(some, runs)

    def _scored(self, pieces: list[list[str]], runs: list[tuple[int, int]]) -> list[tuple[float, int, tuple[int, int]]]:
        """(score, template, run) of the growing runs of ``pieces``, at or over the threshold and near the best of these."""
        which = np.array(sorted({self.words[t] for p in pieces for t in p if t in self.words}), np.int64)
        column = {k: i for i, k in enumerate(which.tolist())}
        tf, others = np.zeros((len(pieces), len(which))), np.zeros(len(pieces))
        for i, bag in enumerate(pieces):
            for t, c in Counter(bag).items():
                k = self.words.get(t)
                if k is None:
                    others[i] += c
                else:
                    tf[i, column[k]] = c
        scores = self.scores(which, np.cumsum(tf, axis=0), np.cumsum(others))
        best = np.argwhere(scores >= max(THRESHOLD, round(float(scores.max(initial=0.0)) - NEAR, 6)))
        return [(float(scores[i, k]), k, runs[i]) for i, k in best.tolist()]


def own_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``files``, all columns but the text, with ``license, score, template, piece, pieces`` of their own best run, else null."""
    kept = [c for c in files.columns if c != text_col]
    rows = files.select(*kept, F.col(text_col).alias("own_text"), F.coalesce(F.col(path_col).rlike(LICENSE_NAME), F.lit(False)).alias("is_license_file"))
    schema = rows.drop("own_text", "is_license_file").schema.add("license", "string").add("score", "double").add("template", "integer").add("piece", "integer").add("pieces", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates()
        for b in batches:
            got = [known.score(t, w) for t, w in zip(b.column(len(kept)).to_pylist(), b.column(len(kept) + 1).to_pylist())]
            cols = [
                pa.array([g and known.licenses[g[1]] for g in got], pa.string()), pa.array([g and g[0] for g in got], pa.float64()),
                *(pa.array([g and g[k] for g in got], pa.int32()) for k in (1, 2, 3)),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *cols], [*kept, "license", "score", "template", "piece", "pieces"])

    return rows.mapInArrow(run, schema)


def ancestors(path: Column) -> Column:
    """array<string>: the directories above a path, nearest last, from the root ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str | None = None) -> DataFrame:
    """``(id_col if given, path, license, score, origin, origin_path)``, one row for each input row.

    Texts are parted into sentences and lines; runs of them that start at one with a key word, and whole licence files by name, are
    compared with every template, and a file's own licence is that of its best run (``header``). Files without one take the licence
    of the nearest directory above that has a licence file by name (``directory``; of several there, the highest score, then the
    smallest path), else null (``none``). Directories are few against files: the nearest licence is found for each distinct
    directory, by joins on its ancestors, and then joined to the files. Null and empty texts have no licence of their own; rows with
    a null path or null id stay, without a directory; repeated rows and rows of one path are scored each on its own; texts are read
    whole, however long; other columns are ignored, whatever their names. Empty input: no rows.
    """
    rows = files.select(*([F.col(id_col).alias("file_id")] if id_col else []), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    own = stage(own_licenses(rows), "own-licenses")
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), "")
    own = own.withColumn("of", directory)
    holders = own.where(F.col("path").rlike(LICENSE_NAME) & F.col("license").isNotNull())
    per_dir = holders.groupBy(F.col("of").alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("b")).select("dir", F.col("b.path").alias("dir_path"), F.col("b.license").alias("dir_license"), (-F.col("b.s")).alias("dir_score"))
    dirs = own.where("license is null and of is not null").select("of").distinct()
    above = dirs.select("of", F.explode(F.array_distinct(F.concat(ancestors(F.col("of")), F.array("of")))).alias("dir"))
    nearest = above.join(per_dir, "dir").groupBy("of").agg(F.max(F.struct(F.length("dir").alias("n"), "dir_path", "dir_license", "dir_score")).alias("b")).select("of", "b.dir_path", "b.dir_license", "b.dir_score")
    out = own.join(nearest, "of", "left")
    mine = F.col("license").isNotNull()
    return out.select(
        *([F.col("file_id").alias(id_col)] if id_col else []), "path", F.coalesce("license", "dir_license").alias("license"), F.when(mine, F.col("score")).otherwise(F.col("dir_score")).alias("score"),
        F.when(mine, "header").when(F.col("dir_license").isNotNull(), "directory").otherwise("none").alias("origin"), F.when(mine, F.col("path")).otherwise(F.col("dir_path")).alias("origin_path"),
    )


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    """Licences of all documents as files ``source/lang/doc_id``: doc_id, path, license, score, origin, origin_path. None of these
    names is a licence file's, so nothing is inherited here; tests do that on trees of named files."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    return scan_licenses(docs.select("doc_id", path.alias("path"), "text"), id_col="doc_id")


def _op9_sql() -> str:
    """Runs, cosines, needed words and ties of `Templates.score` as SQL; the vectors are the templates' own."""
    t = Templates()
    words = sorted(t.words)
    vector = ", ".join(f"({k}, '{words[j]}', {float(t.weights[k, j])!r}::DOUBLE, {bool(t.needed[k, j])})" for k in range(len(t.licenses)) for j in np.flatnonzero(t.weights[k]))
    names = ", ".join(f"({k}, '{spdx}', {t.sizes[k]})" for k, spdx in enumerate(t.licenses))
    idf = ", ".join(f"('{w}', {float(t.idf[j])!r}::DOUBLE, {w in t.keys})" for w, j in t.words.items())
    return rf"""
WITH v(template, token, w, needed) AS (VALUES {vector}), l(template, license, n_words) AS (VALUES {names}), i(token, idf, is_key) AS (VALUES {idf}),
n AS (SELECT template, count(*) FILTER (needed) AS n_needed FROM v GROUP BY template),
f AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || coalesce(doc_id::VARCHAR, '-') AS path, text FROM documents),
k AS (SELECT '\b(' || string_agg(replace(token, '.', '\.'), '|') || ')\b' AS rx FROM i WHERE is_key),
u AS (SELECT row_no, regexp_split_to_array(text, '{PIECE_END}') AS ps FROM f, k WHERE regexp_matches(lower(text), rx)),
p AS (SELECT row_no, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pos, len(ps) AS n_pieces FROM u),
t AS (SELECT row_no, pos, n_pieces, list_transform(regexp_extract_all(piece, '{TOKEN}'), lambda x: lower(x)) AS ts FROM p),
x AS (SELECT row_no, pos, n_pieces, unnest(ts) AS token FROM t),
h AS (SELECT DISTINCT row_no, pos AS start FROM x JOIN i USING (token) WHERE is_key),
o AS (SELECT row_no, pos, len(ts) AS n, row_number() OVER (PARTITION BY row_no ORDER BY pos) AS place FROM t WHERE len(ts) > 0),
r AS (SELECT row_no, start, pos - start + 1 AS run FROM (SELECT h.row_no, start, b.pos, sum(b.n) OVER (PARTITION BY h.row_no, start ORDER BY b.pos) - b.n AS before FROM h JOIN o a ON a.row_no = h.row_no AND a.pos = start JOIN o b ON b.row_no = h.row_no AND b.place BETWEEN a.place AND a.place + {t.run_words}) WHERE before < {t.run_words}),
g AS (SELECT r.row_no, start, run, token, count(*) AS tf FROM r JOIN x ON x.row_no = r.row_no AND pos BETWEEN start AND start + run - 1 GROUP BY ALL),
y AS (SELECT g.*, tf * idf AS x, idf IS NULL AS other FROM g LEFT JOIN i USING (token)),
m AS (SELECT row_no, start, run, sqrt(coalesce(sum(x * x), 0) + coalesce(sum(tf) FILTER (other), 0) * {t.rare * t.rare!r}::DOUBLE) AS norm FROM y GROUP BY ALL),
d AS (SELECT row_no, start, run, template, sum(x * w) AS dot, count(*) FILTER (needed) AS had FROM y JOIN v USING (token) GROUP BY ALL),
s AS (SELECT d.row_no, start, run, d.template, round(dot / norm, 6) AS score FROM d JOIN m USING (row_no, start, run) JOIN n ON n.template = d.template AND had = n_needed),
w AS (SELECT row_no, start, run, template, license, n_words, score, max(score) OVER (PARTITION BY row_no) AS most FROM s JOIN l USING (template) WHERE score >= {THRESHOLD}),
b AS (SELECT row_no, license, score FROM w WHERE score >= round(most - {NEAR}, 6) QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY n_words DESC, score DESC, template, start, run) = 1)
SELECT doc_id, path, license, score, CASE WHEN license IS NULL THEN 'none' ELSE 'header' END AS origin, CASE WHEN license IS NOT NULL THEN path END AS origin_path
FROM f LEFT JOIN b USING (row_no)
"""


OP9_SQL = _op9_sql()
