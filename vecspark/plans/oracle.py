"""Pieces of the equivalent SQL: searches, Lloyd updates and metrics as common table expressions."""

from __future__ import annotations

QD = """q AS MATERIALIZED (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 10 = 0),
d AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 10 <> 0)"""
VE = "ve AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)"
QRELS = """qrels AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, (1 + b.vec_id % 2)::INT AS score
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 10 = 0 AND b.vec_id % 10 <> 0)"""


def topk(docs: str = "d", k: int = 10, queries: str = "q", extra: str = "TRUE") -> str:
    return f"""(SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank, vec_id, s AS score
  FROM (SELECT query_id, vec_id, list_inner_product(q, x) AS s FROM {queries}, {docs} WHERE {extra}) QUALIFY rank <= {k})"""


def unit(v: str) -> str:
    return f"list_transform({v}, lambda e: e / greatest(sqrt(list_inner_product({v}, {v})), 1e-12))"


def scalar(p: str, bits: int, source: str = "d", fit: str = "TRUE") -> str:
    """{p}_s (scale), {p}_c (vec_id, codes), {p}_y (vec_id, x: decoded, unit length)."""
    q = 2 ** (bits - 1) - 1
    return f"""{p}_s AS (SELECT CASE WHEN s = 0 THEN 1.0 ELSE s END AS s FROM (SELECT max(list_max(list_transform(x, lambda e: abs(e)))) / {q} AS s FROM {source} WHERE {fit})),
{p}_c AS MATERIALIZED (SELECT vec_id, list_transform(x, lambda e: greatest(-{q}, least({q}, round_even(e / s, 0)))::INT) AS codes FROM {source}, {p}_s),
{p}_r AS (SELECT vec_id, list_transform(codes, lambda c: c * s) AS y FROM {p}_c, {p}_s),
{p}_y AS MATERIALIZED (SELECT vec_id, {unit("y")} AS x FROM {p}_r)"""


def lloyd(p: str, source: str, m: int, k: int, iterations: int = 3, d: int = 64, seed: int = 42) -> str:
    """{p}_cb (m, code, c) after some Lloyd updates, {p}_codes (vec_id, m, code) and {p}_dec (vec_id, y)."""
    sd = d // m
    out = [
        f"""{p}_sub AS MATERIALIZED (SELECT vec_id, m, x[m * {sd} + 1 : (m + 1) * {sd}] AS s FROM {source}, range({m}) t(m))""",
        f"""{p}_c0 AS MATERIALIZED (SELECT m, rn - 1 AS code, s AS c FROM {p}_sub JOIN (SELECT vec_id, row_number() OVER (ORDER BY md5(vec_id || ':{seed}'), vec_id) AS rn FROM {source}) USING (vec_id) WHERE rn <= {k})""",
    ]
    assign = lambda i: f"SELECT vec_id, m, arg_min(code, row(list_distance(s, c), code)) AS code FROM {p}_sub JOIN {p}_c{i} USING (m) GROUP BY vec_id, m"
    for i in range(iterations):
        out.append(f"{p}_a{i} AS MATERIALIZED ({assign(i)})")
        out.append(
            f"""{p}_u{i} AS MATERIALIZED (SELECT m, code, list(v ORDER BY j) AS c FROM (SELECT m, code, j, avg(v) AS v FROM
  (SELECT m, code, unnest(range(1, {sd + 1})) AS j, unnest(s) AS v FROM {p}_a{i} JOIN {p}_sub USING (vec_id, m)) GROUP BY m, code, j) GROUP BY m, code)"""
        )
        out.append(f"{p}_c{i + 1} AS MATERIALIZED (SELECT a.m, a.code, coalesce(b.c, a.c) AS c FROM {p}_c{i} a LEFT JOIN {p}_u{i} b USING (m, code))")
    out.append(f"{p}_cb AS (SELECT * FROM {p}_c{iterations})")
    out.append(f"{p}_codes AS MATERIALIZED ({assign(iterations)})")
    out.append(f"{p}_dec AS MATERIALIZED (SELECT vec_id, flatten(list(c ORDER BY m)) AS y FROM {p}_codes JOIN {p}_cb USING (m, code) GROUP BY vec_id)")
    return ",\n".join(out)


def metrics(ranking: str, gain: str = "exp2") -> str:
    """per query metrics of a ranking table."""
    g = "pow(2.0, qrels.score) - 1.0" if gain == "exp2" else "1.0"
    return f"""(SELECT n.query_id, coalesce(h5 / n_relevant, 0.0) AS recall_at_5, coalesce(h10 / n_relevant, 0.0) AS recall_at_10, CASE WHEN h10 > 0 THEN 1.0 ELSE 0.0 END AS success,
  coalesce(1.0 / first, 0.0) AS mrr, coalesce(dcg / ideal, 0.0) AS ndcg
 FROM (SELECT query_id, count(*)::DOUBLE AS n_relevant FROM qrels GROUP BY query_id) n
 JOIN (SELECT query_id, sum(gain / log2(place + 1.0)) AS ideal FROM (SELECT query_id, {g} AS gain, row_number() OVER (PARTITION BY query_id ORDER BY {g} DESC) AS place FROM qrels) WHERE place <= 10 GROUP BY query_id) i USING (query_id)
 LEFT JOIN (SELECT r.query_id, sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END)::DOUBLE AS h5, count(*)::DOUBLE AS h10, min(rank)::DOUBLE AS first, sum(({g}) / log2(rank + 1.0)) AS dcg
  FROM {ranking} r JOIN qrels USING (query_id, vec_id) GROUP BY r.query_id) h USING (query_id))"""


def ranking_output(source: str) -> str:
    return f"SELECT query_id, rank, vec_id, round(score, 6) AS score FROM {source}"


def matrix(rotation) -> str:
    """A rotation as rows (i, r): column i of the matrix as a list."""
    return "rot(i, r) AS MATERIALIZED (VALUES " + ", ".join(f"({i}, {[float(v) for v in c]}::DOUBLE[])" for i, c in enumerate(rotation.T)) + ")"


def rotated(source: str, key: str = "vec_id", column: str = "x") -> str:
    return f"(SELECT {key}, list(list_inner_product({column}, r) ORDER BY i) AS {column} FROM {source}, rot GROUP BY {key})"


def ivf(p: str, source: str, nlist: int, m: int = 8, k: int = 16) -> str:
    """{p}_cent (list_id, c), {p}_post (vec_id, list_id), and Lloyd tables {p}p_* over residuals."""
    return f"""{lloyd(p + "c", source, 1, nlist)},
{p}_cent AS MATERIALIZED (SELECT code AS list_id, c FROM {p}c_cb),
{p}_post AS MATERIALIZED (SELECT vec_id, arg_max(list_id, row(s, -list_id)) AS list_id FROM (SELECT vec_id, list_id, list_inner_product(x, c) AS s FROM {source}, {p}_cent) GROUP BY vec_id),
{p}_res AS MATERIALIZED (SELECT vec_id, list_transform(list_zip(x, c), lambda t: t[1] - t[2]) AS x FROM {source} JOIN {p}_post USING (vec_id) JOIN {p}_cent USING (list_id)),
{lloyd(p + "p", p + "_res", m, k)}"""


def ivf_search(p: str, nprobe: int, k: int = 10, queries: str = "q", m: int = 8) -> str:
    sd = 64 // m
    return f"""{p}_probe AS MATERIALIZED (SELECT query_id, q, list_id, s FROM (SELECT query_id, q, list_id, list_inner_product(q, c) AS s FROM {queries}, {p}_cent)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, list_id) <= {nprobe}),
{p}_lut AS MATERIALIZED (SELECT query_id, m, code, list_inner_product(q[m * {sd} + 1 : (m + 1) * {sd}], c) AS v FROM {queries}, {p}p_cb),
{p}_found AS MATERIALIZED (SELECT query_id, vec_id, any_value(s) + sum(v) AS score FROM {p}_probe JOIN {p}_post USING (list_id) JOIN {p}p_codes USING (vec_id) JOIN {p}_lut USING (query_id, m, code) GROUP BY query_id, vec_id),
{p}_top AS MATERIALIZED (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM {p}_found QUALIFY rank <= {k})"""



def again(p: str, other: str, nprobe: int) -> str:
    """A second search of the index of ivf(p), with names of its own."""
    out = ivf_search(p, nprobe)
    for part in ("probe", "lut", "found", "top"):
        out = out.replace(f"{p}_{part}", f"{other}_{part}")
    return out


def encoded(name: str, key: str, source: str, text: str = "text") -> str:
    """name (key, x): hashed word counts of unit length."""
    return f"""{name}_w AS (SELECT {key}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[^\\x20\\x09-\\x0D]+')) AS w FROM {source}),
{name}_n AS (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS n FROM {name}_w GROUP BY ALL),
{name}_v AS (SELECT {key}, list(coalesce(n, 0.0) ORDER BY b) AS v FROM (SELECT DISTINCT {key} FROM {source}) CROSS JOIN range(64) t(b) LEFT JOIN {name}_n USING ({key}, b) GROUP BY {key}),
{name} AS MATERIALIZED (SELECT {key}, {unit("v")} AS x FROM {name}_v)"""
