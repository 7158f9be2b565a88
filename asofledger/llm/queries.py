"""The queries opN_<name>, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, htmltext, interaction, licenses, mixing, pieces, quality, secrets, simhash, toolcalls, toxicity, warc, whitening
from .common import table


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256. Null text counts as empty; repeated rows give a row each."""
    return pieces.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_file())


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_named. Null text has none; repeated rows give a row each."""
    return secrets.digest(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document, places in words. Null text has no words; repeated rows give a row each."""
    return licenses.summary(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keep_id, group_size, kept and text_sha256 of every document; null text is empty text, and of equal texts the smallest doc_id stays."""
    return exact.verdicts(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as its source's quota says, with its pass, block and place in the mixture; null text has no tokens, null source is a source."""
    docs = table(spark, sf_dir, "documents")
    made = mixing.mix(docs.select("doc_id", "text", "source"), block_col="mix_block", place_col="mix_place")
    return made.select("doc_id", "source", "mix_pass", "mix_block", "mix_place")


def op6_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results of every conversation, linked and levelled, as canonical JSON; a table without written calls gives those of its user turns."""
    return toolcalls.format_calls(table(spark, sf_dir, "conversations"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out, score and predicted of every document; null and empty texts score as the bias says."""
    made = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return made.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprint and component_id of every document; null and empty texts have fingerprint zero and are linked."""
    made = simhash.near_classes(table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base_failed, kept and both distances of every document; null text has no words and fails."""
    made = quality.assess(table(spark, sf_dir, "documents"))
    return made.withColumns({c: F.round(c, 9) for c in ("char_distance", "word_distance")})


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, '' for null html or a page without text; repeated rows give a row each."""
    return htmltext.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finite vector's whitened value on the four leading components; rows with a null or non-finite vector are dropped, repeated rows give their rows each."""
    made = whitening.whiten(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    return made.withColumn("deviation", F.col("deviation").cast("long"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as WARC records, read back and assembled: payload length and digest, response or revisit, and the page that a revisit refers to. Null html is an empty payload; repeated rows give a row each."""
    made = warc.round_trip(table(spark, sf_dir, "pages"))
    return made.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from each language's documents at each step of every order. Null text is empty, null lang is ''."""
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op2_secrets, which SQL can express."""
    return op2_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op3_licenses, which SQL can express."""
    return op3_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_secrets, op3_licenses, op4_exact_dedup, op5_mixing, op6_toolcalls, op7_toxicity, op8_simhash, op9_quality, op10_html, op11_whitening, op12_warc, op13_interaction, secrets_base, licenses_base)
}

def _op9_sql() -> str:
    """Base counts, histograms by class and word, references by language, and distances; words that a text lacks add half of their reference share."""
    q = quality
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    classes = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": r"[\x20\x09-\x0D]", "stop": r"[.,;:!?]", "mark": r"['\"()-]", "bar": r"[|]", "symbol": r"[#*$%&<>]", "beyond": r"[^\x00-\x7F]"}
    count = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g'))"
    named = ", ".join(f"{count(p)} AS c_{n}" for n, p in classes.items())
    parts = " UNION ALL ".join(f"SELECT k, lang, '{n}' AS bin, c_{n} AS n FROM a" for n in classes) + " UNION ALL SELECT k, lang, 'other', length(t) - (" + " + ".join(f"c_{n}" for n in classes) + ") FROM a"
    words = ", ".join(f"('{w}')" for w in q.WORDS)
    distance = lambda bins: f"""SELECT k, CASE WHEN sum(n) = 0 THEN 0 ELSE sqrt(greatest((sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + r)) + CASE WHEN r > 0 THEN r * log2(2 * r / (p + r)) ELSE 0 END ELSE 0 END)
            + 1 - sum(CASE WHEN p > 0 THEN r ELSE 0 END)) / 2, 0)) END AS d FROM (SELECT k, n, CASE WHEN own > 0 THEN n / CAST(own AS DOUBLE) ELSE 0 END AS p, ref / CAST(whole AS DOUBLE) AS r FROM (SELECT b.k, b.n, sum(b.n) OVER (PARTITION BY b.k) AS own, ref, whole
            FROM {bins} b JOIN (SELECT lang, bin, sum(n) AS ref, sum(sum(n)) OVER (PARTITION BY lang) AS whole FROM {bins} GROUP BY lang, bin) USING (lang, bin))) GROUP BY k"""  # noqa: E731
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang ELSE 'other' END AS lang FROM documents),
        a AS (SELECT *, {named}, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
        s AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM a),
        v AS (SELECT k, i, [word, lead(word, 1) OVER p, lead(word, 2) OVER p, lead(word, 3) OVER p, lead(word, 4) OVER p] AS five, lead(i, 4) OVER p AS last FROM s WINDOW p AS (PARTITION BY k ORDER BY i)),
        r AS (SELECT k, i, count(*) OVER (PARTITION BY k, five) AS times FROM v WHERE last IS NOT NULL),
        e AS (SELECT k, count(DISTINCT i + j) AS n FROM r, range(0, {q.WINDOW}) x(j) WHERE times > 1 GROUP BY k),
        c AS ({parts}),
        g AS (SELECT k, lang, unnest(regexp_extract_all(translate(t, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM d),
        h AS (SELECT k, lang, CASE WHEN word IN (SELECT * FROM (VALUES {words}) y) THEN word ELSE '' END AS bin, count(*) AS n FROM g GROUP BY ALL),
        cd AS ({distance('c')}), wd AS ({distance('h')}),
        m AS (SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(t) - c_space AS BIGINT) AS word_chars, CAST(c_symbol + c_bar AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(e.n, 0) AS n_repeat_words,
                     coalesce(cd.d, 0) AS char_distance, coalesce(wd.d, 0) AS word_distance FROM a LEFT JOIN e USING (k) LEFT JOIN cd USING (k) LEFT JOIN wd USING (k)),
        f AS (SELECT *, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.REPEAT_PERCENT} * n_words AS base_failed FROM m)
        SELECT * REPLACE (round(char_distance, 9) AS char_distance, round(word_distance, 9) AS word_distance),
               NOT base_failed AND (n_words < {q.CHARS_WORDS} OR char_distance <= {q.CHARS_FAR} + {q.CHARS_NOISE} / sqrt(n_words)) AND (n_words < {q.WORDS_WORDS} OR word_distance <= {q.WORDS_FAR} + {q.WORDS_NOISE} / sqrt(n_words)) AS kept FROM f"""


def _secrets_sql() -> str:
    """Places of the base patterns: what stands between a pattern's matches, and the matches, add up to them."""
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)  # noqa: E731  (the engine's own case folding knows letters beyond ASCII)
    assign = f"({'|'.join(map(either, ('password', 'passwd', 'secret', 'token', 'api_?key')))})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    kinds = {"assign": (assign, 2, 12), "access": ("(AKIA[A-Z0-9]+)", 1, 18), "hex": ("([0-9a-f]+)", 1, 16)}
    parts = " UNION ALL ".join(
        f"""SELECT k, '{kind}' AS kind, {place} AS place, length(g) >= {least} AS counts, s - length(m) AS a, s AS b FROM (SELECT k, m, g, sum(length(m) + length(gap)) OVER (PARTITION BY k ORDER BY i) AS s FROM
        (SELECT k, unnest(m) AS m, unnest(g) AS g, unnest(gaps[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM (SELECT k, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, string_split_regex(t, '{pattern}') AS gaps FROM d)))"""
        for place, (kind, (pattern, group, least)) in enumerate(kinds.items())
    )
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{kind}'), 0) AS n_{kind}" for kind in kinds)
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents), p AS ({parts}), f AS (SELECT k, {counts}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) AS spans FROM p WHERE counts GROUP BY k)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN f USING (k)"""


def _licenses_sql() -> str:
    """Places of each phrase: the words at an index and behind it."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    places = {label: " AND ".join(f"w[i + {j}] = '{word}'" for j, word in enumerate(phrase.split(), 1)) for phrase, label in licenses.PHRASES.items()}
    lists = ", ".join(f"list_filter(range(0, len(w)), lambda i: {test}) AS p_{label}" for label, test in places.items())
    every = "list_concat(" + ", list_concat(".join(f"p_{label}" for label in list(places)[:-1]) + f", p_{list(places)[-1]}" + ")" * (len(places) - 1)
    labels = " || ".join(f"CASE WHEN len(p_{label}) > 0 THEN ',{label}' ELSE '' END" for label in sorted(places))
    return rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents), p AS (SELECT doc_id, w, {lists} FROM d), a AS (SELECT *, {every} AS p FROM p)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, list_min(p) AS first_word, list_max(p) AS last_word, ltrim({labels}, ',') AS base_labels FROM a"""


SQL: dict[str, str] = {
    "secrets_base": _secrets_sql(),
    "licenses_base": _licenses_sql(),
    "op4_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op5_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place,
                          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
        t AS (SELECT source, CAST(sum(n) AS DOUBLE) AS n FROM d GROUP BY source),
        e AS (SELECT CASE WHEN max(n) / min(n) <= 2 THEN 0.0 ELSE 1 - ln(2) / ln(max(n) / min(n)) END AS a FROM t WHERE n > 0),
        w AS (SELECT max(pow(n, 1 - a)) AS widest FROM t, e WHERE n > 0),
        q AS (SELECT source, n, CASE WHEN n > 0 THEN CAST(floor(pow(n, a) * widest + 0.5) AS BIGINT) ELSE 0 END AS quota FROM t, e, w),
        p AS (SELECT source, CASE WHEN n > 0 THEN quota // CAST(n AS BIGINT) ELSE 1 END AS passes, CASE WHEN n > 0 THEN quota % CAST(n AS BIGINT) ELSE 0 END AS rest FROM q),
        g AS (SELECT source, place, sum(n) AS n FROM d GROUP BY source, place),
        h AS (SELECT source, place, coalesce(sum(n) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM g),
        b AS (SELECT greatest(0, least(30, CAST(ceil(log2(greatest(1, count(*)) / 4096.0)) AS INTEGER))) AS bits FROM d),
        c AS (SELECT doc_id, d.source, d.place, reached FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source AND d.place = h.place)
        SELECT doc_id, c.source, CAST(unnest(range(1, passes + CASE WHEN reached < rest THEN 2 ELSE 1 END)) AS INTEGER) AS mix_pass, place >> (60 - (SELECT bits FROM b)) AS mix_block, place AS mix_place
        FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source""",
    "op6_toolcalls": r"""
        WITH f AS (SELECT conv_id, min(turn) AS first FROM conversations WHERE role = 'user' GROUP BY conv_id),
        u AS (SELECT 'call_' || c.conv_id || '_' || c.turn AS call_id, c.conv_id, c.turn, coalesce(c.text, '') AS text, CASE WHEN c.turn > first THEN 'call_' || c.conv_id || '_' || first END AS earlier, a.text AS answer, a.turn IS NOT NULL AS answered
              FROM conversations c JOIN f USING (conv_id) LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant' WHERE c.role = 'user')
        SELECT call_id, conv_id, turn, 'reply' AS name, CASE WHEN earlier IS NULL THEN 0 ELSE 1 END AS level, CASE WHEN answered THEN 'ok' ELSE 'no_result' END AS status, CAST(answered AS BIGINT) AS n_results,
               '{"arguments":{' || coalesce('"after":' || to_json(earlier) || ',', '') || '"text":' || to_json(text) || ',"turn":' || turn || '},"id":' || to_json(call_id) || ',"name":"reply","result":'
               || CASE WHEN answered THEN to_json(coalesce(answer, '')) ELSE 'null' END || '}' AS message FROM u""",
    "op9_quality": _op9_sql(),
    "op12_warc": rf"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        s AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
        r AS (SELECT *, payload_bytes >= {warc.LEAST_BYTES} AND first IS DISTINCT FROM page_id AS again FROM s)
        SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('{warc.BASE32}', 1 + CAST((CAST('0x' || substr(x, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r""",
    "op13_interaction": rf"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CAST(len(w) < {interaction.LEAST_WORDS} AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < {interaction.DISTINCT_PERCENT} * len(w) AS INTEGER)
                     + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {interaction.UPPER_PERCENT} * length(t) AS INTEGER) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS fails
              FROM d LEFT JOIN l USING (doc_id)),
        m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY ALL),
        c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
        o AS (SELECT a.letter || b.letter || c3.letter || d4.letter || e.letter AS filter_order FROM c a, c b, c c3, c d4, c e WHERE a.bit + b.bit + c3.bit + d4.bit + e.bit = 31 AND a.bit | b.bit | c3.bit | d4.bit | e.bit = 31),
        s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bit, CAST(coalesce((SELECT sum(k.bit) FROM c k WHERE contains(substr(filter_order, 1, step - 1), k.letter)), 0) AS INTEGER) AS before FROM o, range(1, 6) r(step), c WHERE c.letter = substr(filter_order, step, 1)),
        q AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (fails & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS removed, coalesce(sum(n) FILTER (fails & before <> 0 AND fails & bit <> 0), 0) AS redundant,
                     coalesce(sum(n) FILTER (fails = bit), 0) AS unique_fails, coalesce(sum(g) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS good_lost, coalesce(sum(x) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS toxic_lost FROM m, s GROUP BY ALL)
        SELECT part, filter_order, step, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))}, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM q""",
}
