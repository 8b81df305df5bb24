"""DuckDB SQL of the registered queries, put together from shared table expressions."""

from __future__ import annotations

# Written for DuckDB from the study's rules, apart from the engine's own expressions.

BM25_K1, BM25_B, BM25_EPSILON = 0.05, 0.03, 0.25

# The default stop words, by their first letters.
STOP = """about above after again against all also and any are because been before being below between both but
can cannot could did does doing down during each even every few for from further had has have having her here hers him his how
into its itself just made make many may more most much must myself neither never nor not now off once one only other our ours
out over own per perhaps please rather same seem several she should since some still such than that the their theirs them then
there these they this those through thus too under until upon very via was well were what when where which while who whom whose
why will with within without would yet you your yours"""

# The suffixes of the stemming algorithm's second to fourth steps.
STEP_2 = "ational ate, tional tion, enci ence, anci ance, izer ize, bli ble, alli al, entli ent, eli e, ousli ous, ization ize, ation ate, ator ate, alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble, logi log"
STEP_3 = "icate ic, ative , alize al, iciti ic, ical ic, ful , ness "
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"

PART = "title_body_tags_answer"
TOP = 20


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _tokens(expr: str) -> str:
    """Words of a text: lower case, tags off, punctuation to spaces, digits off, no stop words, three letters at least."""
    plain = f"regexp_replace(lower({expr}), '<[^>]+>', '', 'g')"
    plain = f"regexp_replace({plain}, '[[:punct:]]', ' ', 'g')"
    plain = f"regexp_replace(regexp_replace({plain}, '[0-9]', '', 'g'), '[[:space:]]+', ' ', 'g')"
    stop = ", ".join(map(_quoted, STOP.split()))
    return f"list_filter(string_split({plain}, ' '), lambda t: length(t) >= 3 AND t NOT IN ({stop}))"


def _html(expr: str) -> str:
    """Text of HTML: code, links and images by words, then no comments, scripts, styles and tags, then entities."""
    expr = f"replace(lower({expr}), chr(10), ' ')"
    for pattern, by in (
        ("(?s)<code>.*?</code>", " codesnippet "), ("(?s)<a.*?https?://.*?[\\x08\\s]?>", " url "), ("(?s)https?://.*?([\\x08\\s]|\\z)", " url "), ("(?s)<img.*?>", " img "),
        ("(?s)<!--.*?-->", ""), ("(?s)<script[^>]*>.*?</script>", ""), ("(?s)<style[^>]*>.*?</style>", ""), ("<[a-z/!][^>]*>", ""),
    ):
        expr = f"regexp_replace({expr}, {_quoted(pattern)}, {_quoted(by)}, 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        expr = f"replace({expr}, {_quoted(name)}, {_quoted(char)})"
    return expr


def _shape(word: str) -> str:
    """V for vowels and C for consonants; y is a vowel after a consonant."""
    shape = f"regexp_replace({word}, '[aeiou]', 'V', 'g')"
    shape = f"regexp_replace({shape}, '([^Vy])y', '\\1V', 'g')"
    shape = f"regexp_replace(regexp_replace({shape}, '^y', 'C'), 'Vy', 'VC', 'g')"
    shape = f"regexp_replace(regexp_replace({shape}, 'Cy', 'CV', 'g'), 'Vy', 'VC', 'g')"
    return f"regexp_replace({shape}, '[^V]', 'C', 'g')"


def _many(word: str, least: int = 1) -> str:
    """Whether vowels are followed by consonants so many times."""
    return f"regexp_matches({_shape(word)}, '{'V+C+' * least}')"


def _short_end(word: str) -> str:
    return f"({_shape(word)} LIKE '%CVC' AND {word} NOT SIMILAR TO '.*[wxy]')"


def _suffixes(name: str, before: str, table: str) -> dict[str, str]:
    """A step that swaps the longest suffix if enough is left before it."""
    pairs = [x.strip(" \n").split(" ") for x in table.split(",")]
    swaps = " ".join(f"WHEN {_quoted(x)} THEN {_quoted(y[0] if y else '')}" for x, *y in pairs)
    cut = f"SELECT word, w, regexp_extract(w, '({'|'.join(x for x, *_ in pairs)})$') AS s FROM {before}"
    return {name: f"SELECT word, CASE WHEN s <> '' AND {_many('left(w, length(w) - length(s))')} THEN left(w, length(w) - length(s)) || CASE s {swaps} END ELSE w END AS w FROM ({cut})"}


_CUT = "left(w, length(w) - length(s))"
#: word, stem of the distinct words, step by step.
STEMS = {
    "vocabulary": "SELECT DISTINCT unnest(words) AS word FROM worded",
    "step_1a": "SELECT word, CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END AS w FROM (SELECT word, word AS w FROM vocabulary)",
    "step_1b": f"SELECT word, CASE WHEN s = '' THEN w WHEN s = 'eed' THEN CASE WHEN {_many(_CUT)} THEN left(w, length(w) - 1) ELSE w END WHEN {_shape(_CUT)} LIKE '%V%' THEN {_CUT} ELSE w END AS w, s IN ('ed', 'ing') AND {_shape(_CUT)} LIKE '%V%' AS cut FROM (SELECT word, w, regexp_extract(w, '(eed|ed|ing)$') AS s FROM step_1a)",
    "step_1c": f"SELECT word, CASE WHEN NOT cut THEN w WHEN w SIMILAR TO '.*(at|bl|iz)' THEN w || 'e' WHEN length(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND {_shape('w')} LIKE '%C' THEN CASE WHEN right(w, 1) IN ('l', 's', 'z') THEN w ELSE left(w, length(w) - 1) END WHEN {_shape('w')} SIMILAR TO 'C*V+C+V*' AND {_short_end('w')} THEN w || 'e' ELSE w END AS w FROM step_1b",
    "step_1d": f"SELECT word, CASE WHEN w LIKE '%y' AND {_shape('left(w, length(w) - 1)')} LIKE '%V%' THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM step_1c",
    **_suffixes("step_2", "step_1d", STEP_2),
    **_suffixes("step_3", "step_2", STEP_3),
    "step_4": f"SELECT word, CASE WHEN s <> '' AND {_many(_CUT, 2)} AND (s <> 'ion' OR {_CUT} SIMILAR TO '.*[st]') THEN {_CUT} ELSE w END AS w FROM (SELECT word, w, regexp_extract(w, '({'|'.join(STEP_4.split())})$') AS s FROM step_3)",
    "step_5": f"SELECT word, CASE WHEN w LIKE '%e' AND ({_many('left(w, length(w) - 1)', 2)} OR ({_many('left(w, length(w) - 1)')} AND NOT {_short_end('left(w, length(w) - 1)')})) THEN left(w, length(w) - 1) ELSE w END AS w FROM step_4",
    "stems": f"SELECT word, CASE WHEN w LIKE '%ll' AND {_many('w', 2)} THEN left(w, length(w) - 1) ELSE w END AS stem FROM step_5",
}


def _lot(expr: str, seed: int = 42) -> str:
    return f"md5(CAST({expr} AS VARCHAR) || ':{seed}')"


#: Table expressions by name, in an order in which each refers to earlier ones only.
CTES = {
    "answers": "SELECT conv_id * 1000 + turn AS id, conv_id AS question_id, CAST(length(text) AS BIGINT) AS score, text AS body, turn AS post_date, turn % 3 = 1 AS accepted FROM conversations WHERE role = 'assistant'",
    "questions": "SELECT d.doc_id AS id, CAST(coalesce(a.n, 0) AS BIGINT) AS n_answers, split_part(d.text, chr(10), 1) AS title, d.text AS body, d.lang || ',' || d.source AS tags FROM documents d LEFT JOIN (SELECT question_id, count(*) AS n FROM answers GROUP BY 1) a ON a.question_id = d.doc_id",
    "pairs": "SELECT d.doc_id AS dup_id, m.main_id FROM documents d JOIN (SELECT text, min(doc_id) AS main_id FROM documents GROUP BY text HAVING count(*) > 1) m ON m.text = d.text WHERE d.doc_id <> m.main_id",
    "dups": "SELECT id FROM questions WHERE id IN (SELECT dup_id FROM pairs)",
    "mains": "SELECT id FROM questions WHERE id IN (SELECT main_id FROM pairs)",
    "comp": "SELECT id FROM questions WHERE n_answers > 0 UNION SELECT id FROM mains",
    "best": "SELECT id, question_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY accepted DESC, top DESC, earliest DESC, id) AS r FROM (SELECT *, score = max(score) OVER (PARTITION BY question_id) AS top, post_date = min(post_date) OVER (PARTITION BY question_id) AS earliest FROM answers)) WHERE r = 1",
    "corpus": "SELECT q.*, coalesce(a.body, '') AS answer FROM questions q LEFT JOIN (SELECT x.question_id, x.body FROM answers x JOIN best b ON b.id = x.id) a ON a.question_id = q.id",
    "worded": f"SELECT id, {_tokens("title || ' ' || body || ' ' || tags || ' ' || answer")} AS words FROM corpus",
    **STEMS,
    "placed": "SELECT id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM worded",
    "stemmed": "SELECT id, list(stem ORDER BY pos) AS toks FROM placed JOIN stems USING (word) GROUP BY 1",
    "tokenized": "SELECT id, coalesce(toks, []) AS toks FROM worded LEFT JOIN stemmed USING (id)",
    "tf": "SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM tokenized) GROUP BY 1, 2",
    "df": "SELECT term, count(*) AS df FROM tf GROUP BY 1",
    "n_docs": "SELECT count(*) AS n FROM tokenized",
    "wtf": "SELECT id, term, sum(tf) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(term), '[\\p{L}\\p{N}_]{2,}')) AS term, tf FROM tf) GROUP BY 1, 2",
    "wdf": "SELECT term, count(*) AS df FROM wtf GROUP BY 1",
    "raw": "SELECT wtf.id, wtf.term, wtf.tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS x FROM wtf JOIN wdf USING (term), n_docs",
    "tfidf": "SELECT raw.id, term, x / norm AS w FROM raw JOIN (SELECT id, sqrt(sum(x * x)) AS norm FROM raw GROUP BY 1) USING (id)",
    "idf0": "SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, n_docs",
    "idf": f"SELECT term, df, CASE WHEN idf < 0 THEN {BM25_EPSILON} * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0",
    "bm25": f"SELECT id, term, tf, tf * idf * ({BM25_K1} + 1) / (tf + {BM25_K1} * (1 - {BM25_B} + {BM25_B} * dl / (SELECT avg(len(toks)) FROM tokenized))) AS w FROM tf JOIN idf USING (term) JOIN (SELECT id, len(toks) AS dl FROM tokenized) USING (id)",
    "s_tfidf": "SELECT a.id AS dup_id, b.id AS main_id, sum(a.w * b.w) AS score FROM (SELECT * FROM tfidf WHERE id IN (SELECT id FROM left_ids)) a JOIN (SELECT * FROM tfidf WHERE id IN (SELECT id FROM right_ids)) b ON a.term = b.term WHERE a.id <> b.id GROUP BY 1, 2",
    "s_bm25": "SELECT a.id AS dup_id, b.id AS main_id, sum(a.tf * b.w) AS score FROM (SELECT * FROM bm25 WHERE id IN (SELECT id FROM left_ids)) a JOIN (SELECT * FROM bm25 WHERE id IN (SELECT id FROM right_ids)) b ON a.term = b.term WHERE a.id <> b.id GROUP BY 1, 2",
    "s_jaccard": "SELECT dup_id, main_id, c / (x.n + y.n - c) AS score FROM (SELECT a.id AS dup_id, b.id AS main_id, count(*) AS c FROM (SELECT * FROM tf WHERE id IN (SELECT id FROM left_ids)) a JOIN (SELECT * FROM tf WHERE id IN (SELECT id FROM right_ids)) b ON a.term = b.term WHERE a.id <> b.id GROUP BY 1, 2) s JOIN (SELECT id, count(*) AS n FROM tf GROUP BY 1) x ON x.id = dup_id JOIN (SELECT id, count(*) AS n FROM tf GROUP BY 1) y ON y.id = main_id",
    "split": f"SELECT id, CASE WHEN r <= round_even((SELECT count(*) FROM dups) * 0.2, 0) THEN 'test' ELSE 'train' END AS part FROM (SELECT id, row_number() OVER (ORDER BY {_lot('id')}, id) AS r FROM dups)",
    "free_q": "SELECT id FROM questions WHERE id NOT IN (SELECT dup_id FROM pairs) AND id NOT IN (SELECT main_id FROM pairs)",
    "noise": f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY {_lot('id')}, id) AS r FROM free_q) WHERE r <= round_even((SELECT count(*) FROM dups) * 0.2, 0)",
}
ALL = ("SELECT id FROM dups", "SELECT id FROM comp")
TRAIN = ("SELECT id FROM split WHERE part = 'train' UNION ALL SELECT id FROM noise", "SELECT id FROM comp WHERE id NOT IN (SELECT id FROM split WHERE part = 'test')")
TEST = ("SELECT id FROM split WHERE part = 'test'", "SELECT id FROM comp")


def _ranks(measure: str) -> str:
    """Tie-aware ranks over the complete table of duplicates and comparison questions."""
    return f"""SELECT dup_id, main_id, score, rank FROM (
        SELECT dup_id, main_id, score, rank() OVER (PARTITION BY dup_id ORDER BY score DESC) + (count(*) OVER (PARTITION BY dup_id, score) - 1) / 2 AS rank
        FROM (SELECT d.id AS dup_id, c.id AS main_id, coalesce(round(s.score, 6), 0.0) AS score FROM dups d JOIN comp c ON c.id <> d.id LEFT JOIN s_{measure} s ON s.dup_id = d.id AND s.main_id = c.id)
    ) JOIN pairs USING (dup_id, main_id)"""


def _top(measure: str, n: int = TOP) -> str:
    return f"""SELECT dup_id, candidate_id, score, CAST(rk AS INTEGER) AS rk FROM (
        SELECT dup_id, candidate_id, score, row_number() OVER (PARTITION BY dup_id ORDER BY score DESC, candidate_id) AS rk
        FROM (SELECT d.id AS dup_id, c.id AS candidate_id, coalesce(round(s.score, 6), 0.0) AS score FROM left_ids d JOIN right_ids c ON c.id <> d.id LEFT JOIN s_{measure} s ON s.dup_id = d.id AND s.main_id = c.id)
    ) WHERE rk <= {n}"""


_CTE_ORDER = list(CTES)


def sql(query: str, scope: tuple[str, str] = ALL, **more: str) -> str:
    """The query behind the table expressions that it needs, directly or through others; `more` come last."""
    import re

    named = dict(CTES) | {"left_ids": scope[0], "right_ids": scope[1]} | more
    wanted: set[str] = set()

    def need(text: str) -> None:
        for name in named:
            if name not in wanted and re.search(rf"\b{name}\b(?!\()", re.sub(r"'[^']*'", "", text)):
                wanted.add(name)
                need(named[name])

    need(query)
    order = []

    def place(name: str) -> None:
        if name in order:
            return
        for other in named:
            if other != name and other in wanted and re.search(rf"\b{other}\b(?!\()", re.sub(r"'[^']*'", "", named[name])) and (other in more or name in more or other in ("left_ids", "right_ids") or name in ("left_ids", "right_ids") or _CTE_ORDER.index(other) < _CTE_ORDER.index(name)):
                place(other)
        order.append(name)

    for name in named:
        if name in wanted:
            place(name)
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({named[n]})" for n in order) + "\n" + query if order else query


_LABELLED = "SELECT t.*, p.dup_id IS NOT NULL AS is_dup FROM top_c t LEFT JOIN (SELECT DISTINCT * FROM pairs) p ON p.dup_id = t.dup_id AND p.main_id = t.candidate_id"
_TRAIN = {"top_c": _top("tfidf"), "lab": _LABELLED, "train_c": "SELECT lab.*, n.id IS NOT NULL AS is_noise FROM lab LEFT JOIN noise n ON n.id = lab.dup_id"}
_TEST = {"top_c": _top("tfidf"), "lab": _LABELLED, "test_c": "SELECT lab.*, false AS is_noise FROM lab"}


def _both(query: str) -> str:
    """Train and test candidates in one statement: their scopes differ, so the expressions have names of their own."""

    def scoped(text: str, tag: str) -> str:
        for name in ("left_ids", "right_ids", "s_tfidf", "top_c", "lab"):
            text = text.replace(f" {name}", f" {name}_{tag}").replace(f"({name}", f"({name}_{tag}").replace(f"{name}.", f"{name}_{tag}.") if name != "lab" else text.replace(" lab ", f" lab_{tag} ").replace("lab.*", f"lab_{tag}.*").replace("lab.dup_id", f"lab_{tag}.dup_id")
        return text

    more = {}
    for tag, scope, own in (("a", TRAIN, _TRAIN), ("b", TEST, _TEST)):
        more |= {f"left_ids_{tag}": scope[0], f"right_ids_{tag}": scope[1], f"s_tfidf_{tag}": scoped(CTES["s_tfidf"], tag), f"top_c_{tag}": scoped(own["top_c"], tag), f"lab_{tag}": scoped(own["lab"], tag)}
    more |= {"train_c": scoped(_TRAIN["train_c"], "a"), "test_c": scoped(_TEST["test_c"] + " ", "b")}
    return sql(query, **more)


def _recall(table: str, order: str, ks=(5, 10, 20), by: str = "", name: str = "rr_") -> str:
    hits = ", ".join(f"bool_or(is_dup AND r <= {k}) AS h{k}" for k in ks)
    means = ", ".join(f"avg(CAST(h{k} AS DOUBLE)) AS {name}{k}" for k in ks)
    group = f"{by}, " if by else ""
    return f"SELECT {group}{means} FROM (SELECT {group}dup_id, {hits} FROM (SELECT *, row_number() OVER (PARTITION BY dup_id ORDER BY {order}, candidate_id) AS r FROM {table}) GROUP BY ALL)" + (" GROUP BY ALL" if by else "")


def _shown(expr: str) -> str:
    return f"printf('%.2f', avg({expr})) || ' ' || CASE WHEN stddev_samp({expr}) IS NULL THEN '' ELSE '(' || printf('%.2f', round(stddev_samp({expr}), 2)) || ')' END"


_ALL_RANKS = {f"r_{m}": _ranks(m) for m in ("jaccard", "tfidf", "bm25")} | {"all_r": "SELECT 'jaccard' AS feature, * FROM r_jaccard UNION ALL SELECT 'tfidf', * FROM r_tfidf UNION ALL SELECT 'bm25', * FROM r_bm25"}
_RATES = "SELECT {0}" + ", ".join(f"avg(CAST(h{k} AS DOUBLE)) AS recall_{k}" for k in (5, 10, 20)) + " FROM (SELECT {0}dup_id, " + ", ".join(f"bool_or(rank <= {k}) AS h{k}" for k in (5, 10, 20)) + " FROM {1} GROUP BY ALL)"
_MISSED = """SELECT dup_id, coalesce(true_main, first_main) AS main_id, top_ranked, has_dup FROM (
    SELECT dup_id, bool_or(is_dup AND r <= 5) AS hit, bool_or(is_dup) AS has_dup, min_by(candidate_id, r) FILTER (WHERE is_dup) AS true_main, min_by(candidate_id, r) FILTER (WHERE NOT is_dup) AS top_ranked
    FROM (SELECT *, row_number() OVER (PARTITION BY dup_id ORDER BY -score DESC, candidate_id) AS r FROM test_c) GROUP BY 1
) LEFT JOIN (SELECT dup_id, min(main_id) AS first_main FROM pairs GROUP BY 1) USING (dup_id) WHERE NOT hit"""
_URL = "'https://stackoverflow.com/questions/' || {0} || '/' AS {0}_url"
_VECTORS = "FROM (SELECT e.vec_id AS dup_id, f.main_id, e.embedding AS v1, g.embedding AS v2 FROM embeddings e JOIN (SELECT label, min(vec_id) AS main_id FROM embeddings GROUP BY 1) f ON e.label = f.label JOIN embeddings g ON g.vec_id = f.main_id WHERE e.vec_id <> f.main_id)"
_D = "list_transform({0}, lambda x: CAST(x AS DOUBLE))"
_EVERY_VECTOR = f"SELECT dup_id, main_id, h.vec_id AS candidate_id, round(list_cosine_similarity({_D.format('v1')}, {_D.format('h.embedding')}), 6) AS score {_VECTORS} p JOIN embeddings h ON h.vec_id <> dup_id"
_NORMED = "list_transform({0}, lambda x: abs(CAST(x AS DOUBLE)) / list_sum(list_transform({0}, lambda y: abs(CAST(y AS DOUBLE)))))"
_HALF = "CASE WHEN z[{0}] > 0 THEN z[{0}] * ln(z[{0}] / ((z[1] + z[2]) / 2)) ELSE 0.0 END"
_FEATURES = ", ".join(f"round(coalesce(f_{m}.score, 0.0), 5) AS {PART}_{m}_sim" for m in ("bm25", "jaccard", "tfidf"))

ORACLE_SQL = {
    "tag_filter": sql("SELECT id, tags FROM questions WHERE list_has_any(string_split(lower(tags), ','), ['fr', 'de', 'src3', 'src7'])"),
    "best_answer": sql("SELECT id, question_id FROM best"),
    "answered_without_best": sql("SELECT DISTINCT question_id FROM answers WHERE question_id NOT IN (SELECT question_id FROM best)"),
    "bm25_neighbours": sql("SELECT dup_id, main_id, score, CAST(rk AS INTEGER) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY dup_id ORDER BY score DESC, main_id) AS rk FROM (SELECT a.id AS dup_id, b.id AS main_id, round(sum(a.tf * b.w), 6) AS score FROM (SELECT * FROM bm25 WHERE id IN (SELECT id FROM mains)) a JOIN bm25 b ON a.term = b.term GROUP BY 1, 2)) WHERE rk <= 3"),
    "question_with_answer": sql("SELECT id, n_answers, CAST(length(title) AS INTEGER) AS title_length, md5(answer) AS answer_md5 FROM corpus"),
    "corpus_index": sql("SELECT id, row_number() OVER (ORDER BY id) - 1 AS corpus_index, CAST(length(title || ' ' || body || ' ' || tags || ' ' || answer) AS INTEGER) AS length FROM corpus"),
    "corpus_faults": sql("SELECT CAST(0 AS BIGINT) AS nulls, count(*) - count(DISTINCT id) AS repeated_ids, CAST(0 AS BIGINT) AS repeated_indexes, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS missing FROM corpus"),
    "dup_pairs": sql("SELECT dup_id, main_id FROM pairs"),
    "duplicate_ids": sql("SELECT id FROM dups"),
    "main_ids": sql("SELECT id FROM mains"),
    "answered_ids": sql("SELECT id FROM questions WHERE n_answers > 0"),
    "comparison_ids": sql("SELECT id FROM comp"),
    "pairs_both_in_set": sql("SELECT dup_id, main_id FROM pairs WHERE dup_id IN (SELECT id FROM tagged) AND main_id IN (SELECT id FROM tagged)", tagged="SELECT id FROM questions WHERE list_has_any(string_split(lower(tags), ','), ['en', 'fr'])"),
    "questions_in_pairs": sql("SELECT id, id IN (SELECT dup_id FROM pairs) OR id IN (SELECT main_id FROM pairs) AS in_pair FROM questions"),
    "noise_sample": sql("SELECT id FROM noise"),
    "train_test_split": sql("SELECT id, part FROM split"),
    "stratified_sample": sql(f"SELECT id FROM questions WHERE id NOT IN (SELECT id FROM free_q) UNION ALL SELECT id FROM (SELECT id, row_number() OVER (ORDER BY {_lot('id')}, id) AS r FROM free_q) WHERE r <= (SELECT count(*) // 2 FROM questions) - (SELECT count(*) FROM questions WHERE id NOT IN (SELECT id FROM free_q))"),
    "html_to_text": f"SELECT page_id, {_html('html')} AS text FROM pages",
    "html_to_text_parsed": f"SELECT page_id, {_html('html')} AS text FROM pages",
    "tokenize_counts": sql("SELECT id, CAST(len(toks) AS INTEGER) AS n_tokens, CAST(len(list_distinct(toks)) AS INTEGER) AS n_terms, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM tokenized"),
    "stemmed_terms": sql("SELECT stem AS term, count(*) AS n, count(DISTINCT id) AS docs FROM placed JOIN stems USING (word) GROUP BY 1"),
    "term_freq": sql("SELECT id, term, tf FROM tf"),
    "doc_freq": sql("SELECT term, df FROM df"),
    "tfidf_weights": sql("SELECT id, term, round(w, 6) AS w FROM tfidf"),
    "bm25_idf": sql("SELECT term, df, round(idf, 6) AS idf FROM idf"),
    "bm25_weights": sql("SELECT id, term, tf, round(w, 6) AS w FROM bm25"),
    "jaccard_pairs": sql("SELECT dup_id, main_id, round(score, 5) AS score FROM s_jaccard"),
    "tfidf_pairs": sql("SELECT dup_id, main_id, round(score, 5) AS score FROM s_tfidf"),
    "bm25_pairs": sql("SELECT dup_id, main_id, round(score, 5) AS score FROM s_bm25"),
    "bm25_query": sql("SELECT id, round(sum(n * w), 5) AS score FROM bm25 JOIN (VALUES ('onin', 1), ('tion', 2), ('ther', 1), ('nosuchterm', 1)) q(t, n) ON t = term GROUP BY 1"),
    "tfidf_topk": sql(_top("tfidf")),
    "bm25_most_similar": sql(_top("bm25")),
    "dense_cosine_pairs": f"SELECT dup_id, main_id, round(list_cosine_similarity({_D.format('v1')}, {_D.format('v2')}), 5) AS score {_VECTORS}",
    "dense_cosine_topk": f"SELECT dup_id, candidate_id, score, rk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dup_id ORDER BY score DESC, candidate_id) AS INTEGER) AS rk FROM ({_EVERY_VECTOR})) WHERE rk <= 20",
    "dense_pair_ranks": f"SELECT dup_id, main_id, score, rank FROM (SELECT *, rank() OVER (PARTITION BY dup_id ORDER BY score DESC) + (count(*) OVER (PARTITION BY dup_id, score) - 1) / 2.0 AS rank FROM ({_EVERY_VECTOR})) WHERE candidate_id = main_id",
    "jsd_pairs": f"SELECT dup_id, main_id, round(1 - sqrt(greatest(list_sum(list_transform(list_zip({_NORMED.format('v1')}, {_NORMED.format('v2')}), lambda z: ({_HALF.format(1)} + {_HALF.format(2)}) / 2)), 0.0)), 5) AS score {_VECTORS}",
    "pair_ranks": sql(_ranks("tfidf")),
    "recall_rates": sql(_RATES.format("", "ranks_t"), ranks_t=_ranks("tfidf")),
    "recall_by_feature": sql(_RATES.format("feature, ", "all_r") + " GROUP BY 1", **_ALL_RANKS),
    "train_candidates": sql("SELECT * FROM train_c", TRAIN, **_TRAIN),
    "test_candidates": sql("SELECT * FROM test_c", TEST, **_TEST),
    "limited_candidates": sql("SELECT * FROM train_c WHERE rk <= 5", TRAIN, **_TRAIN),
    "undersampled": sql(
        f"""SELECT dup_id, candidate_id, score, rk, is_dup, is_noise FROM train_c WHERE is_dup UNION ALL
        SELECT dup_id, candidate_id, score, rk, is_dup, is_noise FROM (SELECT *, row_number() OVER (PARTITION BY dup_id ORDER BY md5(dup_id || '-' || candidate_id || ':42'), candidate_id) AS draw FROM train_c WHERE NOT is_dup) JOIN quotas USING (dup_id) WHERE draw <= part""",
        TRAIN,
        **_TRAIN,
        positives="SELECT 3 * count(*) AS q FROM train_c WHERE is_dup",
        quotas="SELECT dup_id, q // n + CASE WHEN pos < q % n THEN 1 ELSE 0 END AS part FROM (SELECT dup_id, row_number() OVER (ORDER BY dup_id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT dup_id FROM train_c WHERE NOT is_dup)), positives",
    ),
    "merged_candidates": _both("SELECT dup_id, candidate_id, score, is_dup, is_noise FROM train_c UNION SELECT dup_id, candidate_id, score, is_dup, is_noise FROM test_c"),
    "cv_folds": sql(f"SELECT dup_id, CAST(ntile(5) OVER (ORDER BY {_lot('dup_id')}, dup_id) AS INTEGER) AS fold FROM fold_d WHERE NOT noisy UNION ALL SELECT dup_id, 0 FROM fold_d WHERE noisy", TRAIN, **_TRAIN, fold_d="SELECT dup_id, bool_or(is_noise) AS noisy FROM train_c GROUP BY 1"),
    "feature_matrix": sql(f"SELECT t.dup_id, t.candidate_id, t.is_dup, {_FEATURES} FROM test_c t " + " ".join(f"LEFT JOIN s_{m} f_{m} ON f_{m}.dup_id = t.dup_id AND f_{m}.main_id = t.candidate_id" for m in ("bm25", "jaccard", "tfidf")), TEST, **_TEST),
    "feature_faults": sql("SELECT CAST(count(*) FILTER (WHERE dup_id = candidate_id) AS BIGINT) AS self_pairs, count(*) - count(DISTINCT (dup_id, candidate_id)) AS repeated, CAST(0 AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS missing FROM test_c", TEST, **_TEST),
    "ranked_recall_by_score": sql(_recall("test_c", "score DESC", (1, 5, 10)), TEST, **_TEST),
    "misclassified": sql(f"SELECT *, {', '.join(_URL.format(c) for c in ('dup_id', 'main_id', 'top_ranked'))} FROM missed", TEST, **_TEST, missed=_MISSED),
    "misclassified_counts": sql(
        "SELECT tested, missed_n AS missed, CAST(coalesce(round_even(missed_n / nullif(tested, 0) * 100, 0), 0) AS BIGINT) AS missed_percent, not_retrieved, CAST(coalesce(round_even(not_retrieved / nullif(missed_n, 0) * 100, 0), 0) AS BIGINT) AS not_retrieved_percent FROM (SELECT (SELECT count(DISTINCT dup_id) FROM test_c) AS tested, count(*) AS missed_n, CAST(coalesce(sum(CASE WHEN has_dup THEN 0 ELSE 1 END), 0) AS BIGINT) AS not_retrieved FROM missed_d)",
        TEST,
        **_TEST,
        missed_d=_MISSED,
    ),
    "similarity_summary": sql(
        f"SELECT 'documents' AS dataset_name, score, similarity, {_shown('value')} AS {PART} FROM ("
        + " UNION ALL ".join(f"SELECT 'recall-rate@{k}' AS score, CASE feature WHEN 'jaccard' THEN 'Jaccard' WHEN 'tfidf' THEN 'TF-IDF' ELSE 'BM25' END AS similarity, round(recall_{k} * 100, 2) AS value FROM rates" for k in (5, 10, 20))
        + ") GROUP BY 1, 2, 3",
        **_ALL_RANKS,
        rates=_RATES.format("feature, ", "all_r") + " GROUP BY 1",
    ),
    "dataset_sizes": sql(
        "SELECT source, topic, format('{:,}', CAST(round(avg(questions)) AS BIGINT)) AS questions, format('{:,}', CAST(round(avg(questions) - avg(duplicates)) AS BIGINT)) AS non_duplicates, format('{:,}', CAST(round(avg(duplicates)) AS BIGINT)) || ' (' || printf('%.1f', round(avg(duplicates) / avg(questions) * 100, 1)) || '%)' AS duplicates, format('{:,}', CAST(round(avg(n_pairs)) AS BIGINT)) AS pairs FROM sizes GROUP BY 1, 2",
        sizes="SELECT CASE WHEN lang = 'en' THEN 'English' ELSE 'Other' END AS source, 'Prose' AS topic, count(*) AS questions, count(k) AS duplicates, coalesce(sum(np), 0) AS n_pairs FROM documents LEFT JOIN (SELECT dup_id AS k, count(*) AS np FROM pairs GROUP BY 1) ON k = doc_id GROUP BY lang",
    ),
    "cross_dataset_summary": sql(
        "SELECT 'all' AS dataset_train, CASE WHEN lang = 'en' THEN 'English' ELSE 'Other' END AS dataset_test, " + ", ".join(f"{_shown(f'round(rr_{k} * 100, 2)')} AS rr_{k}" for k in (5, 10, 20)) + " FROM by_lang GROUP BY 1, 2",
        TEST,
        **_TEST,
        with_lang="SELECT t.*, lang FROM test_c t JOIN documents ON doc_id = dup_id",
        by_lang=_recall("with_lang", "score DESC", by="lang"),
    ),
    "candidate_summary": sql(
        "SELECT n_candidates, " + ", ".join(f"{_shown(f'round(rr_{k} * 100, 2)')} AS rr_{k}" for k in (5, 10, 20)) + " FROM (" + " UNION ALL ".join(f"SELECT {n} AS n_candidates, * FROM ({_recall(f'(SELECT * FROM test_c WHERE rk <= {n})', 'score DESC')})" for n in (1, 5, TOP)) + ") GROUP BY 1",
        TEST,
        **_TEST,
    ),
    "rank_outliers": sql("SELECT feature, dup_id, main_id, round(l, 6) AS log10_rank, l < quantile_cont(l, 0.25) OVER w - 1.5 * (quantile_cont(l, 0.75) OVER w - quantile_cont(l, 0.25) OVER w) AS outlier FROM (SELECT *, log10(rank) AS l FROM all_r) WINDOW w AS (PARTITION BY feature)", **_ALL_RANKS),
    "xml_answers": sql("SELECT id, question_id, score, md5(replace(body, chr(10), ' ')) AS body_md5, CAST(post_date AS BIGINT) AS post_date, id IN (SELECT min(id) FROM answers WHERE accepted AND question_id IN (SELECT id FROM questions) GROUP BY question_id) AS accepted FROM answers"),
    "xml_dup_pairs": sql("SELECT dup_id, main_id FROM pairs WHERE dup_id IN (SELECT id FROM tagged) AND main_id IN (SELECT id FROM tagged)", tagged="SELECT id FROM questions WHERE list_has_any(string_split(lower(tags), ','), ['en', 'fr'])"),
    "tag_subset": sql(
        "SELECT 'question_texts' AS artefact, count(*) AS n FROM tagged UNION ALL SELECT 'answer_texts', count(*) FROM answers WHERE question_id IN (SELECT id FROM tagged) UNION ALL SELECT 'dup_pairs', count(*) FROM pairs WHERE dup_id IN (SELECT id FROM tagged) AND main_id IN (SELECT id FROM tagged)",
        tagged="SELECT id FROM questions WHERE list_has_any(string_split(lower(tags), ','), ['fr', 'de', 'src3', 'src7'])",
    ),
    "encoder_pairs": sql(
        "SELECT dup_id, main_id, round(CASE WHEN list_sum(list_transform(x, lambda v: v * v)) * list_sum(list_transform(y, lambda v: v * v)) = 0 THEN 0.0 ELSE list_cosine_similarity(x, y) END, 5) AS score FROM (SELECT q.id AS dup_id, f.main_id, q.v AS x, g.v AS y FROM lettered q JOIN (SELECT tags, min(id) AS main_id FROM questions GROUP BY 1) f USING (tags) JOIN lettered g ON g.id = f.main_id WHERE q.id <> f.main_id)",
        lettered="SELECT id, tags, [" + ", ".join(f"CAST(length(body) - length(replace(body, '{chr(97 + k)}', '')) AS DOUBLE)" for k in range(26)) + "] AS v FROM questions",
    ),
    "xml_questions": sql("SELECT id, n_answers, title, md5(replace(body, chr(10), ' ')) AS body_md5, tags FROM questions"),
}
