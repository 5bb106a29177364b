"""License scans with DataFrame functions only: diagonal voting of word k-grams against license texts.

Every rolling k-gram hash of every document is joined to the template positions with the same hash. Each hit
votes for the diagonal (position in the text minus position in the template); neighbouring diagonals, which a
word more or less sets apart, are merged into one run. Spans are then verified: the words of a run are compared with
those of the template, one by one, on each of its diagonals, and a run in which enough of the template stands
word for word gives the template's label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import null_safe

K = 5  #: words of a k-gram
DRIFT = 3  #: words between diagonals that are merged
COVER = 0.5  #: part of a template's k-grams that a run must hold to be verified
EQUAL = 0.8  #: part of a template's words that must stand in the run
STRETCH = 1.5  #: a run's words against the template's

# Phrases and their labels.
PHRASES = {"cc-by": ("cc", "by"), "gpl": ("general", "public", "license"), "reserved": ("all", "rights", "reserved")}
# Notices that licenses ask for, their core sentences, and short licenses whole; and the labels of the method.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-2.0-notice": """licensed under the apache license version 2 0 the license you may not use this file except in compliance
        with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by
        applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without
        warranties or conditions of any kind either express or implied see the license for the specific language governing
        permissions and limitations under the license""",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-2-clause-text": """redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of
        conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this
        list of conditions and the following disclaimer in the documentation and or other materials provided with the
        distribution this software is provided by the copyright holders and contributors as is and any express or implied
        warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose
        are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental
        special exemplary or consequential damages including but not limited to procurement of substitute goods or services
        loss of use data or profits or business interruption however caused and on any theory of liability whether in contract
        strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if
        advised of the possibility of such damage""",
    "cc-by-notice": "this work is licensed under a creative commons attribution",
    "gpl-notice": "licensed under the gnu general public license",
    "gpl-3.0-notice": """this program is free software you can redistribute it and or modify it under the terms of the gnu general
        public license as published by the free software foundation either version 3 of the license or at your option any later
        version this program is distributed in the hope that it will be useful but without any warranty without even the implied
        warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details""",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-text": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies the software is provided as is
        and the author disclaims all warranties with regard to this software including all implied warranties of merchantability
        and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any
        damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other
        tortious action arising out of or in connection with the use or performance of this software""",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights to
        use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
        software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the software the software is provided as is without warranty
        of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular
        purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other
        liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or
        the use or other dealings in the software""",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "zlib-text": """this software is provided as is without any express or implied warranty in no event will the authors be held
        liable for any damages arising from the use of this software permission is granted to anyone to use this software for
        any purpose including commercial applications and to alter it and redistribute it freely subject to the following
        restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original
        software if you use this software in a product an acknowledgment in the product documentation would be appreciated but
        is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the
        original software 3 this notice may not be removed or altered from any source distribution""",
}

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def lowered(text: Column) -> Column:
    """A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case."""
    return F.filter(F.split(lowered(text), f"{_BREAK}+", -1), lambda x: x != "")


def grams(w: Column) -> Column:
    """Hash of each run of K words; none if there are fewer."""
    at = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(K)])
    return F.when(F.size(w) >= K, F.transform(F.sequence(F.lit(0), F.size(w) - K), at))


def template_grams(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``label, t_pos, gram``: the positions of each template; as many rows as the templates have words."""
    return template_words(spark, templates).select("label", F.posexplode(grams(F.col("t_words"))).alias("t_pos", "gram"))


def template_words(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``label, t_words``: a row a template."""
    rows = spark.createDataFrame(sorted(templates.items()), "label string, body string")
    return rows.select("label", words(F.col("body")).alias("t_words"))


def license_runs(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Verified runs: ``doc_id, copy, label, first, last, equal, score``; first and last are word positions.

    ``copy`` is a hash of the text, which tells rows of one doc_id apart. ``equal`` is the number of the template's words
    that stand on one of the run's diagonals, ``score`` their part of the template.
    """
    spark = docs.sparkSession
    copy = F.xxhash64("text").alias("copy")
    each = docs.select("doc_id", copy, words(F.col("text")).alias("w")).select("doc_id", "copy", grams(F.col("w")).alias("g"), "w")
    # outer: an inner explode makes the optimizer test the array first, which would compute it a second time
    hits = each.select("doc_id", "copy", "w", F.posexplode_outer("g").alias("pos", "gram"))
    # the templates are an argument of fixed size, not a table: always the side that is sent
    hits = hits.join(F.broadcast(template_grams(spark, templates)), "gram")
    # a hit brings the K words behind its hash, so that what is verified need not be fetched from the text again
    hits = hits.select("doc_id", "copy", "label", "t_pos", "pos", F.slice("w", F.col("pos") + 1, F.lit(K)).alias("found"))
    voted = hits.groupBy("doc_id", "copy", "label", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set(F.struct("t_pos", "found")).alias("at")
    )
    order = Window.partitionBy("doc_id", "copy", "label").orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT).cast("int")
    run = F.sum(F.coalesce(fresh, F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = voted.withColumn("run", run).groupBy("doc_id", "copy", "label", "run").agg(
        F.min("first").alias("first"), (F.max("last") + K - 1).alias("last"), F.flatten(F.collect_list("at")).alias("at")
    )
    merged = merged.join(F.broadcast(template_words(spark, templates)), "label")  # of fixed size as well
    size = F.size("t_words")
    covered = F.size(F.array_distinct(F.transform("at", lambda x: x["t_pos"])))
    extent = F.col("last") - F.col("first") + 1 <= STRETCH * size
    alike = F.filter(
        F.flatten(F.transform("at", lambda x: F.transform(x["found"], lambda word, j: F.struct((x["t_pos"] + j).alias("t"), word.alias("word"))))),
        lambda y: F.get(F.col("t_words"), y["t"]) == y["word"],
    )
    equal = F.size(F.array_distinct(F.transform(alike, lambda y: y["t"])))
    found = merged.where((covered >= COVER * (size - K + 1)) & extent).withColumn("equal", equal)
    found = found.withColumn("score", F.col("equal") / F.size("t_words")).where(F.col("score") >= EQUAL)
    return found.select("doc_id", "copy", "label", "first", "last", "equal", "score")


def license_labels(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row for each input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is the best score of a verified run, 1 where only a phrase stands, else 0. A null or empty text has no
    words. Rows that share a doc_id have the labels of their own text each.
    """
    w = F.col("w")
    might = "|".join(f"{_BREAK}+".join(p) for p in PHRASES.values())
    stands = lambda p: F.filter(
        F.sequence(F.lit(0), F.size(w) - len(p)),
        lambda i: _all([F.get(w, i + j) == x for j, x in enumerate(p)]),
    )
    none = F.array().cast("array<int>")
    places = {
        label: F.when(F.col("might") & (F.size(w) >= len(p)), stands(p)).otherwise(none) for label, p in PHRASES.items()
    }
    body = F.coalesce("text", F.lit(""))
    base = (
        docs.select("doc_id", F.xxhash64("text").alias("copy"), words(body).alias("w"), lowered(body).rlike(might).alias("might"))
        .select("doc_id", "copy", F.size("w").alias("n"), *[c.alias(f"p{k}") for k, c in enumerate(places.values())])
        .withColumn("places", F.concat(*[f"p{k}" for k in range(len(places))]))
    )
    runs = license_runs(docs, templates).groupBy("doc_id", "copy").agg(
        F.collect_set("label").alias("own"), F.max("score").alias("best")
    )
    named = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, label) for k, label in enumerate(places)]))
    own = F.coalesce("own", F.array().cast("array<string>"))
    size = F.size("places").cast("long")
    return null_safe(base, runs, "doc_id", "copy").select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        size.alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(named), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(named, own)), ",").alias("labels"),
        F.coalesce("best", F.when(size > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out
