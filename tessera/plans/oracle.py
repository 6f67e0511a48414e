"""The test views of ``views.py`` written as DuckDB SQL common table
expressions, used by the independent SQL oracle."""

from __future__ import annotations

# Same character class as tessera.functions.text.WHITESPACE_CLASS, RE2 syntax.
WS = r"[\t\n\x{0b}\f\r\x{1c}-\x{1f}\x{85}\p{Z}]+"


def tokens_sql(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{WS}'), lambda x: x <> '')"


VIEWS = {
    "sent": """
      SELECT doc_id, line_no, doc_id * 2147483648 + line_no AS sid, lang, text FROM (
        SELECT doc_id, lang,
               unnest(range(len(string_split(text, chr(10))))) AS line_no,
               unnest(string_split(text, chr(10))) AS text
        FROM documents)""",
    "sent_tok": f"""
      SELECT doc_id, line_no, sid, lang, text, {tokens_sql('text')} AS tokens FROM sent""",
    "ids": """
      SELECT sid, list_append(list_transform(tokens, lambda t: length(t) % 12), 2) AS ids FROM sent_tok""",
    "bpe": r"""
      SELECT sid, regexp_replace(text, '([A-Za-z]{4})([A-Za-z])', '\1@@ \2', 'g') AS seg FROM sent""",
    "tok": """
      SELECT doc_id, line_no, sid, unnest(range(len(tokens))) AS pos, unnest(tokens) AS tok
      FROM sent_tok""",
    "pair": """
      SELECT conv_id * 2147483648 + turn AS id, conv_id, turn, text AS src, next_text AS tgt FROM (
        SELECT conv_id, turn, role, text,
               lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
               lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
        FROM conversations)
      WHERE role = 'user' AND next_role = 'assistant'""",
    "gold": """
      SELECT l.doc_id AS id, l.quality AS gold, (d.n_chars % 100) / 100.0 AS score, l.toxic
      FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "hyp": """
      SELECT l_orderkey AS id, l_linenumber AS rank, -l_extendedprice / 10000.0 AS score,
             CAST(l_quantity AS INTEGER) AS len
      FROM lineitem""",
    "emb": """
      SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings""",
    "metric": """
      SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
             ts, value, event_id % 7 + 1 AS n, event_type
      FROM events""",
}

# Views that other views read.
DEPS = {"sent_tok": ["sent"], "tok": ["sent_tok"], "ids": ["sent_tok"], "bpe": ["sent"]}


def with_views(body: str, *names: str, extra: dict | None = None) -> str:
    """Prefix ``body`` with the CTEs it needs (dependencies first); ``extra``
    adds query-specific CTEs after the views, in the given order."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({VIEWS[n]})" for n in order]
    ctes += [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    if not ctes:
        return body
    text = body.lstrip()
    if text[:14].upper() == "WITH RECURSIVE":  # merge, keeping the recursive marker
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + text[14:]
    if text[:4].upper() == "WITH":  # merge the body's own CTE list
        return "WITH " + ",\n".join(ctes) + ",\n" + text[4:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
