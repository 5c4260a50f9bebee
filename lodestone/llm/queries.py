"""The queries over these operators, each over its whole table, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every twentieth one by integer inner product; see topk.top_k(). Vectors that are null or hold a null or a value that is not finite take no part."""
    from lodestone.llm.topk import top_k

    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = table(spark, sf_dir, "embeddings").filter(finite).select("vec_id", F.transform(x, lambda c: F.floor(c * 64)).alias("vector"))
    return top_k(rows, rows.filter("vec_id % 20 = 0"), k=20)


def held_out(folds: int) -> Column:
    """Whether the CRC-32 of the doc_id as text leaves 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == 2


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, quantiles and truncated totals for every context limit; see counts.token_counts(). Null texts have no tokens."""
    from lodestone.llm.counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from three folds of four; see language.predict(). A null text, or one without a letter, is und."""
    from lodestone.llm.language import identify, train

    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(4))
    model = train(docs.filter("not held_out"))
    return identify(docs, model).withColumn("held_out", held_out(4)).select("doc_id", "held_out", "lang_pred", "score")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document; see neardup.near_duplicates(). Null texts are like no other; long ones are compared whole."""
    from lodestone.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), least=0.8)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards of even bytes, equal texts together; see sharding.assign(). A null text has 16 bytes; a text of any length is one document."""
    from lodestone.llm.sharding import assign

    out = assign(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2048 tokens; see packing.pack(). A null text is its end token; only longer documents are cut."""
    from lodestone.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), capacity=2048, end_id=0)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by word_bpe_49k.json and decoded; see bpe.encode_decode(). A null text is an empty one."""
    from lodestone.llm.bpe import encode_decode

    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of equal texts stays; see dedup.exact_duplicates(). A null text is an empty one; long ones are compared whole."""
    from lodestone.llm.dedup import exact_duplicates

    out = exact_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by the lattice of pieces, learned from six folds of seven; see lattice.score(). A null text is its end."""
    from lodestone.llm.lattice import score

    return score(table(spark, sf_dir, "documents").withColumn("held_out", held_out(7)), public_tokenizers.path(WORD_BPE))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each text loses to texts of smaller ids; see suffixes.remove_repeats(). A null text is an empty one."""
    from lodestone.llm.suffixes import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts, each with the common word one edit away that it is a form of; see spelling.variants()."""
    from lodestone.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), every=199, least=6, times=5, ratio=5)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's phrases of two to four words that belong together; see phrases.collocations()."""
    from lodestone.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"), least=30, depth=4, most=2000, share=80)


def op13_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by piece_bpe_32k.model with begin and end, and decoded; a null text is an empty one."""
    from lodestone.llm.pieces import encode_decode

    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))
    return out.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_top_k, op2_token_counts, op3_language_id, op4_minhash_near_dedup, op5_sharding, op6_best_fit_packing, op7_bpe_codec, op8_exact_dedup, op9_lm_scoring, op10_suffix_array_dedup, op11_spelling_variants, op12_phrase_collocations, op13_sentencepiece_codec)
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
            FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
        )
        SELECT * FROM ranked WHERE rank <= 20
    """,
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
    """,
    # CRC-32 bit by bit: each byte is a step, and eight steps of -1 follow it
    "op11_spelling_variants": """
        WITH RECURSIVE runs AS (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
                   unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
        ), coded AS (
            SELECT run, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c), -1, -1, -1, -1, -1, -1, -1, -1]
                   ELSE [192 + unicode(c) // 64, -1, -1, -1, -1, -1, -1, -1, -1, 128 + unicode(c) % 64, -1, -1, -1, -1, -1, -1, -1, -1] END)) AS steps
            FROM runs WHERE length(run) >= 6
        ), hashed AS (
            SELECT run, 4294967295 - list_reduce(steps, lambda c, x: CASE WHEN x >= 0 THEN xor(CAST(c AS BIGINT), CAST(x AS BIGINT)) ELSE xor(CAST(c AS BIGINT) // 2, CAST(c AS BIGINT) % 2 * 3988292384) END, CAST(4294967295 AS BIGINT)) AS h FROM coded
        ), words AS (
            SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM hashed)
            WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5
        ), places AS (
            SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words
        ), cut AS (
            SELECT word, n, p, left(word, p - 1) AS head, substr(word, p + 1) AS tail FROM places
        ), near AS (
            SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut AS a JOIN cut AS b ON a.p = b.p AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
            UNION SELECT w.word, w.n, c.word, c.n FROM words AS w JOIN cut AS c ON w.word = c.head || c.tail
            UNION SELECT c.word, c.n, w.word, w.n FROM words AS w JOIN cut AS c ON w.word = c.head || c.tail
        ), best AS (
            SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k FROM near
        ), forms AS (
            SELECT word, n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM best WHERE k = 1
        ), chain AS (
            SELECT word, word AS root, 0 AS step FROM words UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain AS c JOIN forms AS f ON f.word = c.root AND f.form IS NOT NULL
        ), ends AS (
            SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word
        )
        SELECT word, form, root, n, coalesce(n_near, 0) AS n_near, form_n FROM words LEFT JOIN forms USING (word) JOIN ends USING (word)
    """,
    "op12_phrase_collocations": """
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
        ), worded AS (
            SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
        ), places AS (
            SELECT lang, w, unnest(range(1, len(w) + 1)) AS p FROM worded
        ), grams AS (
            SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase FROM places, range(1, 5) AS s(k) WHERE p + k - 1 <= len(w)
        ), f AS (
            SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY lang, k, phrase
        ), totals AS (
            SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
        ), candidates AS (
            SELECT lang, k, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE k > 1 AND n >= 30
        ), inner_phrases AS (
            SELECT lang, array_to_string(w[p:p + m - 1], ' ') AS phrase, max(a) AS longer FROM candidates, range(2, 4) AS s(m), range(1, 4) AS t(p)
            WHERE m < k AND p + m - 1 <= k GROUP BY ALL
        ), kept AS (
            SELECT c.* FROM candidates AS c LEFT JOIN inner_phrases AS i USING (lang, phrase) WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT)
        ), cuts AS (
            SELECT c.lang, c.phrase, c.a, x.n AS l, y.n AS r, j, CAST(CAST(2000000 AS HUGEINT) * c.a // (x.n + y.n) AS BIGINT) AS score
            FROM kept AS c, range(1, 4) AS s(j), f AS x, f AS y
            WHERE j < c.k AND x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ') AND y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')
        ), lowest AS (
            SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS first FROM cuts
        ), ranked AS (
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM lowest WHERE first = 1
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
}
