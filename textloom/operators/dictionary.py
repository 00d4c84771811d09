"""Census, dictionary and tokenization (survey 2.4, first half)."""

#: Words of the dictionary.
POOL = 44_515

_TOK = "SELECT doc_id, explode(regexp_extract_all(fold(text), '[a-z]+', 0)) AS tok FROM @documents"
_CENSUS = f"SELECT tok, count(*) AS cnt FROM ({_TOK}) GROUP BY tok"
_POOL = f"SELECT tok, cnt FROM ({_CENSUS}) ORDER BY cnt DESC, tok LIMIT {POOL}"
_RANKS = f"SELECT tok, cnt, row_number() OVER (ORDER BY cnt DESC, tok) - 1 AS r FROM ({_POOL})"
_LEN = "CASE WHEN r < 80 THEN 1 WHEN r < 3920 THEN 2 WHEN r < 44880 THEN 3 ELSE 0 END"
#: A codeword as a number, its first byte in the lowest place.
_CODE = """CASE WHEN r < 80 THEN 128 + r
 WHEN r < 3920 THEN 208 + (r - 80) DIV_ 80 + (128 + (r - 80) % 80) * 256
 WHEN r < 44880 THEN 240 + (r - 3920) DIV_ 80 DIV_ 32 + (208 + (r - 3920) DIV_ 80 % 32) * 256 + (128 + (r - 3920) % 80) * 65536
 ELSE 0 END"""
_CASED = "SELECT doc_id, n, element_at_1(toks, n) AS tok FROM (SELECT doc_id, toks, explode(sequence(1, size(toks))) AS n FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z]?[a-z]+|[A-Z]+', 0) AS toks FROM @documents) WHERE size(toks) > 0)"

QUERIES = {
    "vocab_census": f"SELECT tok, cnt FROM ({_CENSUS})",
    "vocab_topk": _POOL,
    "dict_rank": f"SELECT tok, r FROM ({_RANKS})",
    "codeword": f"SELECT tok, r, CAST({_CODE} AS BIGINT) AS code, CAST({_LEN} AS BIGINT) AS n_bytes FROM ({_RANKS})",
    "codeword_decode": f"SELECT tok, CAST(CASE WHEN code < 256 THEN code - 128 WHEN code < 65536 THEN (code % 256 - 208) * 80 + code DIV_ 256 - 128 + 80 ELSE ((code % 256 - 240) * 32 + code DIV_ 256 % 256 - 208) * 80 + code DIV_ 65536 - 128 + 3920 END AS BIGINT) AS r FROM (SELECT tok, CAST({_CODE} AS BIGINT) AS code FROM ({_RANKS}))",
    "dict_members": f"SELECT DISTINCT t.tok FROM ({_TOK}) t WHERE t.tok IN (SELECT tok FROM ({_POOL}))",
    "dict_stragglers": f"SELECT t.tok, count(*) AS cnt FROM ({_TOK}) t LEFT JOIN ({_POOL}) p ON t.tok = p.tok WHERE p.tok IS NULL GROUP BY t.tok",
    "dict_gaps": f"SELECT tok, place, CASE WHEN place > before THEN place - before ELSE 0 END AS gap, before IS NULL OR place < before AS restart FROM (SELECT tok, r, place, lag(place) OVER (ORDER BY r) AS before FROM (SELECT tok, r, row_number() OVER (ORDER BY tok) AS place FROM ({_RANKS})))",
    "tokens_cased": f"SELECT doc_id, n, tok, CASE WHEN rlike(tok, '^[A-Z][a-z]+$') OR rlike(tok, '^[A-Z]$') THEN 'cap' WHEN rlike(tok, '^[A-Z]+$') THEN 'upper' ELSE 'lower' END AS mark FROM ({_CASED})",
    "dict_encode": f"SELECT c.doc_id, count(*) AS n_tokens, CAST(sum(CASE WHEN d.r IS NULL THEN length(c.tok) ELSE {_LEN} END) AS BIGINT) AS n_bytes, CAST(sum(CASE WHEN d.r IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_raw FROM (SELECT doc_id, fold(tok) AS tok FROM ({_CASED})) c LEFT JOIN ({_RANKS}) d ON c.tok = d.tok GROUP BY c.doc_id",
    "affix_match": f"""SELECT tok, part, kind FROM (SELECT tok, part, kind, row_number() OVER (PARTITION BY tok ORDER BY kind DESC, length(part) DESC) AS best FROM (
 SELECT tok, substr(tok, length(tok) - n + 1, n) AS part, 'suffix' AS kind FROM (SELECT tok, explode(sequence(7, length(tok) - 1)) AS n FROM ({_CENSUS}) WHERE length(tok) > 7)
 UNION ALL SELECT tok, substr(tok, 1, n) AS part, 'prefix' AS kind FROM (SELECT tok, explode(sequence(7, length(tok) - 1)) AS n FROM ({_CENSUS}) WHERE length(tok) > 7))
 WHERE part IN (SELECT tok FROM ({_POOL}))) WHERE best = 1""",
    "tokens_per_lang": "SELECT lang, count(*) AS n, count(DISTINCT tok) AS kinds FROM (SELECT lang, explode(regexp_extract_all(fold(text), '[a-z]+', 0)) AS tok FROM @documents) GROUP BY lang",
}
