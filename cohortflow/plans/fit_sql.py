"""SQL twins of the fits: preparation, penalised logistic regression by proximal gradient steps, randomised trees, nested validation.

Nothing here is shared with the operators; the gradient steps and the levels of trees run as recursive queries.
"""

from __future__ import annotations

# Label of the model frame: spending inputs plus seeded noise.
LABELLED_SQL = """ord AS (SELECT o_custkey AS entity_id, count(*) / 10.0::DOUBLE AS x0, avg(o_totalprice) / 100000.0::DOUBLE AS x1, avg((o_orderstatus = 'F')::INT::DOUBLE) AS x2 FROM orders GROUP BY 1),
raw_frame AS (SELECT c_custkey AS entity_id, x0, x1, x2, CASE WHEN c_acctbal > 0 THEN c_acctbal / 1000.0::DOUBLE END AS x3 FROM customer JOIN ord ON entity_id = c_custkey),
frame AS (SELECT *, (x2 + 0.3::DOUBLE * coalesce(x3, 0) / 10 + ('0x' || substr(md5('5|' || entity_id), 1, 4))::BIGINT / 65536.0::DOUBLE > 1.1)::INT AS label FROM raw_frame)"""

#: Twice what standardised inputs need for fifteen digits.
STEPS = 600


def prepared(rows: str, cols: list[str], flags: list[str], name: str) -> str:
    """CTEs from rows (key, entity_id, y, wt, inputs) to `<name>_z` with standardised features z0.. per key; flags are inputs with an indicator."""
    features = [*cols, *[f"missing_{c}" for c in flags]]
    med = ", ".join(f"coalesce(quantile_cont({c}, 0.5), 0) AS {c}" for c in cols)
    fill = ", ".join([*[f"coalesce(r.{c}, m.{c}) AS {c}" for c in cols], *[f"(r.{c} IS NULL)::INT::DOUBLE AS missing_{c}" for c in flags]])
    std = ", ".join(f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) > 1e-12 * greatest(1, abs(avg({f}))) THEN stddev_pop({f}) ELSE 1 END AS s_{f}" for f in features)
    z = ", ".join(f"(f.{f} - m_{f}) / s_{f} AS z{i}" for i, f in enumerate(features))
    return f"""{name}_med AS (SELECT key, {med} FROM {rows} GROUP BY key),
{name}_fill AS (SELECT r.key, entity_id, y, wt, {fill} FROM {rows} r JOIN {name}_med m USING (key)),
{name}_std AS (SELECT key, {std} FROM {name}_fill GROUP BY key),
{name}_z AS (SELECT f.key, entity_id, y, wt, {z} FROM {name}_fill f JOIN {name}_std USING (key))"""


def descent(z: str, settings: str, features: int, name: str, steps: int = STEPS) -> str:
    """CTEs to `<name>` (key, cand, b, w0..): minimum of mean loss + ((1 - l1)/2 |w|^2 + l1 |w|_1) / (C * weight).

    `settings` has key, cand, c, l1 and u0.. (1 where the candidate uses the feature, else 0).
    """
    k = range(features)
    line = " + ".join(["b", *[f"w{i} * z{i}" for i in k]])
    error = f"(1 / (1 + exp(-({line}))) - y)"
    weights = ", ".join(f"w{i}" for i in k)
    sums = ", ".join([f"sum(wt * {error}) / sum(wt) AS gb", *[f"sum(wt * z{i} * {error}) / sum(wt) AS g{i}" for i in k]])
    kept = ", ".join(f"any_value({c}) AS {c}" for c in ["c", "l1", "b", *[f"w{i}" for i in k], *[f"u{i}" for i in k]])
    moved = ", ".join(f"u{i} * sign(v{i}) * greatest(abs(v{i}) - rate * l1 / (c * sw), 0) AS w{i}" for i in k)
    # The step allows for the curvature of the penalty.
    stepped = ", ".join(f"w{i} - rate * (g{i} + (1 - l1) / (c * sw) * w{i}) AS v{i}" for i in k)
    return f"""{name}_gd AS (SELECT key, cand, c, l1, 0 AS step, 0.0::DOUBLE AS b, {", ".join(f"0.0::DOUBLE AS w{i}" for i in k)}, {", ".join(f"u{i}" for i in k)} FROM {settings}
  UNION ALL SELECT key, cand, c, l1, step + 1, b, {moved}, {", ".join(f"u{i}" for i in k)} FROM (
    SELECT key, cand, c, l1, step, sw, rate, b - rate * gb AS b, {stepped}, {", ".join(f"u{i}" for i in k)} FROM (
      SELECT *, 1 / (1 + (1 - l1) / (c * sw)) AS rate FROM (SELECT s.key, cand, step, sum(wt) AS sw, {kept}, {sums} FROM {name}_gd s JOIN {z} d ON s.key = d.key GROUP BY s.key, cand, step))) WHERE step < {steps}),
{name} AS (SELECT key, cand, b, {weights} FROM {name}_gd WHERE step = {steps})"""


def single(cols: list[str], flags: list[str], c: float, l1: float, *, weight: str = "1.0", name: str = "fit", source: str = "frame") -> str:
    """CTEs of one fit on the whole frame."""
    n = len(cols) + len(flags)
    return f"""{name}_rows AS (SELECT 'all' AS key, entity_id, label AS y, ({weight})::DOUBLE AS wt, {", ".join(cols)} FROM {source}),
{prepared(f"{name}_rows", cols, flags, name)},
{name}_set AS (SELECT 'all' AS key, 'one' AS cand, {c}::DOUBLE AS c, {l1}::DOUBLE AS l1, {", ".join(f"1 AS u{i}" for i in range(n))}),
{descent(f"{name}_z", f"{name}_set", n, name)}"""


BALANCED = "CASE WHEN label = 1 THEN (SELECT count(*) / (2.0::DOUBLE * sum(label)) FROM frame) ELSE (SELECT count(*) / (2.0::DOUBLE * (count(*) - sum(label))) FROM frame) END"


def coefficients(cols: list[str], flags: list[str], name: str = "fit", digits: int = 3) -> str:
    """Rows input, coefficient of a single fit."""
    names = [*cols, *[f"missing_{c}" for c in flags]]
    parts = [f"SELECT 'intercept' AS input, round(b, {digits}) AS coefficient FROM {name}", *[f"SELECT '{n}', round(w{i}, {digits}) FROM {name}" for i, n in enumerate(names)]]
    return " UNION ALL ".join(parts)


def nested(
    candidates: list[tuple[str, str, list[str], float, float]], cols: list[str], *, seed: int, outer: int, inner: int, flags: list[str] = (), name: str = "n",
) -> str:
    """CTEs of a nested validation: `<name>_inner` (k, cand, recipe, ap), `<name>_held` (inner scores), `<name>_oof` (scores of every candidate's refit on its outer fold).

    Candidates are (name, recipe, inputs, C, l1).  Without outer folds (0) everything runs on all rows, as k = 1.  Folds deal every class out in the order of a seeded hash.
    """
    features = [*cols, *[f"missing_{c}" for c in flags]]
    uses = lambda inputs: ", ".join(f"{int(f in inputs or f.removeprefix('missing_') in inputs)} AS u{i}" for i, f in enumerate(features))
    listed = " UNION ALL ".join(f"SELECT '{n}' AS cand, '{r}' AS recipe, {c}::DOUBLE AS c, {l1}::DOUBLE AS l1, {uses(inputs)}" for n, r, inputs, c, l1 in candidates)
    order = f"md5('{seed}|' || entity_id), entity_id"
    n = len(features)
    z = ", ".join(f"(coalesce(f.{c}, m.{c}) - m_{c}) / s_{c} AS z{i}" for i, c in enumerate(cols))
    z += "".join(f", ((f.{c} IS NULL)::INT - m_missing_{c}) / s_missing_{c} AS z{len(cols) + i}" for i, c in enumerate(flags))
    line = " + ".join(["b", *[f"w{i} * z{i}" for i in range(n)]])
    fold = f"CAST((row_number() OVER (PARTITION BY label ORDER BY {order}) - 1) % {outer} + 1 AS INTEGER)" if outer else "0"
    return f"""{name}_folds AS (SELECT *, {fold} AS fold FROM frame),
{name}_train AS (SELECT k, f.*, (row_number() OVER (PARTITION BY k, label ORDER BY {order}) - 1) % {inner} + 1 AS inner_fold FROM {name}_folds f, (SELECT unnest(range(1, {max(outer, 1) + 1})) AS k) WHERE fold <> k),
{name}_rows AS (SELECT k || ':' || j AS key, entity_id, label AS y, 1.0::DOUBLE AS wt, {", ".join(cols)} FROM {name}_train, (SELECT unnest(range({inner + 1})) AS j) WHERE j = 0 OR inner_fold <> j),
{prepared(f"{name}_rows", cols, list(flags), name)},
{name}_cands AS ({listed}),
{name}_set AS (SELECT key, cand, c, l1, {", ".join(f"u{i}" for i in range(n))} FROM {name}_cands, (SELECT DISTINCT key FROM {name}_rows)),
{descent(f"{name}_z", f"{name}_set", n, f"{name}_fit")},
{name}_ask AS (SELECT k, inner_fold AS j, entity_id, label, {", ".join(cols)} FROM {name}_train UNION ALL SELECT fold, 0, entity_id, label, {", ".join(cols)} FROM {name}_folds),
{name}_scored AS (SELECT k, j, cand, entity_id, label, 1 / (1 + exp(-({line}))) AS score FROM (
  SELECT f.k, f.j, f.k || ':' || f.j AS key, entity_id, label, {z} FROM {name}_ask f JOIN {name}_med m ON m.key = f.k || ':' || f.j JOIN {name}_std s ON s.key = m.key) q JOIN {name}_fit USING (key)),
{name}_held AS (SELECT * FROM {name}_scored WHERE j > 0),
{name}_oof AS (SELECT k AS fold, cand, entity_id, label, score FROM {name}_scored WHERE j = 0),
{name}_tied AS (SELECT k, cand, j, score, sum(label) AS p, count(*) AS n FROM {name}_held GROUP BY ALL),
{name}_run AS (SELECT *, sum(p) OVER w AS pu, sum(n) OVER w AS nu FROM {name}_tied WINDOW w AS (PARTITION BY k, cand, j ORDER BY score DESC)),
{name}_ap AS (SELECT k, cand, j, sum(p * pu / nu::DOUBLE) / sum(p)::DOUBLE AS ap FROM {name}_run GROUP BY ALL),
{name}_inner AS (SELECT k, cand, recipe, avg(ap) AS ap FROM {name}_ap JOIN {name}_cands USING (cand) GROUP BY ALL)"""


def forest(rows: str, specs: str, inputs: int, seed: int, name: str) -> str:
    """CTEs to `<name>_score` (key, cand, entity_id, y, train, score) and `<name>_walk` (every row at every node it passes).

    `rows` has key, entity_id, y, train and x0.. without gaps; `specs` has key, cand, trees, tried, max_depth, min_split, min_leaf,
    zero and one (class weights). A level is one step of the recursion; draws are digests of seed, tree, path and input.
    """
    k = range(inputs)
    node = "PARTITION BY key, cand, tree, path"
    spec = "trees, tried, max_depth, min_split, min_leaf, zero, one"
    xs = ", ".join(f"x{i}" for i in k)
    digests = ", ".join(f"md5('{seed}|' || tree || '|' || path || '|{i}') AS d{i}" for i in k)
    ends = ", ".join(f"min(x{i}) FILTER (train) OVER (w) AS lo{i}, max(x{i}) FILTER (train) OVER (w) AS hi{i}" for i in k)
    order = "list_sort([" + ", ".join(f"{{'h': substr(d{i}, 1, 8), 'i': {i}}}" for i in k) + "])"
    ranks = ", ".join(f"list_position(drawn, {{'h': substr(d{i}, 1, 8), 'i': {i}}}) AS r{i}, lo{i} + ('0x' || substr(d{i}, 9, 12))::BIGINT / 281474976710656.0::DOUBLE * (hi{i} - lo{i}) AS u{i}" for i in k)
    first = "least(" + ", ".join(f"CASE WHEN lo{i} < hi{i} THEN r{i} ELSE {inputs + 1} END" for i in k) + f", {inputs + 1}) AS first_spread"
    cut = ", ".join(f"CASE WHEN u{i} >= hi{i} THEN lo{i} ELSE u{i} END AS t{i}, lo{i} < hi{i} AND (r{i} <= tried OR (first_spread > tried AND r{i} = first_spread)) AS ok{i}" for i in k)
    sides = ", ".join(f"count(*) FILTER (train AND x{i} <= t{i}) OVER (w) AS a{i}, coalesce(sum(y) FILTER (train AND x{i} <= t{i}) OVER (w), 0) AS p{i}" for i in k)

    def purity(n: str, p: str) -> str:
        return f"((({n} - {p}) * zero) * (({n} - {p}) * zero) + ({p} * one) * ({p} * one)) / (({n} - {p}) * zero + {p} * one)"

    trials = ", ".join(
        f"CASE WHEN ok{i} AND least(a{i}, n - a{i}) >= min_leaf THEN {{'g': -({purity(f'a{i}', f'p{i}')} + {purity(f'(n - a{i})', f'(positives - p{i})')}), 'r': r{i}, 'i': {i}, 't': t{i}}} END" for i in k)
    may = "positives > 0 AND positives < n AND n >= min_split AND n >= 2 * min_leaf AND (max_depth IS NULL OR length(path) < max_depth)"
    w = lambda text: text.replace("OVER (w)", f"OVER ({node})")
    return f"""{name}_walk AS (
  SELECT r.key, cand, tree, '' AS path, entity_id, y, train, {xs}, {spec} FROM {rows} r JOIN (SELECT *, unnest(range(trees)) AS tree FROM {specs}) s ON r.key = s.key
  UNION ALL
  SELECT key, cand, tree, path || CASE WHEN [{xs}][best.i + 1] <= best.t THEN '0' ELSE '1' END, entity_id, y, train, {xs}, {spec} FROM (
    SELECT *, list_sort(list_filter([{trials}], lambda s: s IS NOT NULL))[1] AS best FROM (
      SELECT *, {w(sides)} FROM (
        SELECT *, {cut} FROM (
          SELECT *, {first} FROM (
            SELECT *, {ranks} FROM (
              SELECT *, {order} AS drawn FROM (
                SELECT *, {digests}, {w(ends)}, count(*) FILTER (train) OVER ({node}) AS n, coalesce(sum(y) FILTER (train) OVER ({node}), 0) AS positives FROM {name}_walk)) WHERE {may}))))) WHERE best IS NOT NULL
),
{name}_ends AS (SELECT key, cand, tree, entity_id, any_value(y) AS y, any_value(train) AS train, max_by(path, length(path)) AS path, any_value(zero) AS zero, any_value(one) AS one FROM {name}_walk GROUP BY key, cand, tree, entity_id),
{name}_leaves AS (SELECT *, count(*) FILTER (train) OVER ({node}) AS n, coalesce(sum(y) FILTER (train) OVER ({node}), 0) AS positives FROM {name}_ends),
{name}_score AS (SELECT key, cand, entity_id, any_value(y) AS y, any_value(train) AS train, avg(positives * one / ((n - positives) * zero + positives * one)) AS score FROM {name}_leaves GROUP BY key, cand, entity_id)"""


def tree_specs(settings: list[tuple[str, dict]], sizes: str, inputs: int) -> str:
    """Rows of specs for every setting (name, parameters) and training set of `sizes` (key, n, positives)."""
    parts = []
    for name, p in settings:
        tried = {"sqrt": f"floor(sqrt({inputs}))", "log2": f"floor(log2({inputs}))"}.get(p.get("max_features", "sqrt"), f"floor({p.get('max_features')} * {inputs})")
        weight = p.get("class_weight", "balanced")
        zero, one = ("n / (2.0::DOUBLE * (n - positives))", "n / (2.0::DOUBLE * positives)") if weight == "balanced" else (f"{float(v)}::DOUBLE" for v in weight.split(":"))
        depth = p.get("max_depth")
        parts.append(f"SELECT key, '{name}' AS cand, {p.get('n_estimators', 800)} AS trees, greatest(1, {tried})::INT AS tried, {'NULL::INT' if depth is None else depth} AS max_depth, {p.get('min_samples_split', 6)} AS min_split, {p.get('min_samples_leaf', 2)} AS min_leaf, {zero} AS zero, {one} AS one FROM {sizes}")
    return " UNION ALL ".join(parts)


def nested_forests(settings: list[tuple[str, dict]], cols: list[str], *, seed: int, outer: int, inner: int, name: str = "n") -> str:
    """CTEs of a nested validation of trees: `<name>_held` (k, j, cand, entity_id, label, score), `<name>_oof` (fold, cand, ...), `<name>_inner` (k, cand, ap)."""
    order = f"md5('{seed}|' || entity_id), entity_id"
    med = ", ".join(f"coalesce(quantile_cont({c}, 0.5) FILTER (train), 0) AS {c}" for c in cols)
    xs = ", ".join(f"coalesce(r.{c}, m.{c}) AS x{i}" for i, c in enumerate(cols))
    return f"""{name}_folds AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY {order}) - 1) % {outer} + 1 AS INTEGER) AS fold FROM frame),
{name}_train AS (SELECT k, f.*, (row_number() OVER (PARTITION BY k, label ORDER BY {order}) - 1) % {inner} + 1 AS inner_fold FROM {name}_folds f, (SELECT unnest(range(1, {outer} + 1)) AS k) WHERE fold <> k),
{name}_raw AS (SELECT k || ':' || j AS key, entity_id, label AS y, inner_fold <> j AS train, {", ".join(cols)} FROM {name}_train, (SELECT unnest(range(1, {inner} + 1)) AS j)
  UNION ALL SELECT k || ':0', entity_id, label, fold <> k, {", ".join(cols)} FROM {name}_folds, (SELECT unnest(range(1, {outer} + 1)) AS k)),
{name}_med AS (SELECT key, {med} FROM {name}_raw GROUP BY key),
{name}_rows AS (SELECT r.key, entity_id, y, train, {xs} FROM {name}_raw r JOIN {name}_med m ON r.key = m.key),
{name}_sizes AS (SELECT key, count(*) AS n, sum(y) AS positives FROM {name}_rows WHERE train GROUP BY key),
{name}_specs AS ({tree_specs(settings, f"{name}_sizes", len(cols))}),
{forest(f"{name}_rows", f"{name}_specs", len(cols), seed, name)},
{name}_all AS (SELECT split_part(key, ':', 1)::INT AS k, split_part(key, ':', 2)::INT AS j, cand, entity_id, y AS label, score FROM {name}_score WHERE NOT train),
{name}_held AS (SELECT * FROM {name}_all WHERE j > 0),
{name}_oof AS (SELECT k AS fold, cand, entity_id, label, score FROM {name}_all WHERE j = 0),
{name}_tied AS (SELECT k, cand, j, score, sum(label) AS p, count(*) AS n FROM {name}_held GROUP BY ALL),
{name}_run AS (SELECT *, sum(p) OVER w AS pu, sum(n) OVER w AS nu FROM {name}_tied WINDOW w AS (PARTITION BY k, cand, j ORDER BY score DESC)),
{name}_ap AS (SELECT k, cand, j, sum(p * pu / nu::DOUBLE) / sum(p)::DOUBLE AS ap FROM {name}_run GROUP BY ALL),
{name}_inner AS (SELECT k, cand, avg(ap) AS ap FROM {name}_ap GROUP BY ALL)"""


def metrics(oof: str, keys: str) -> str:
    """AUC, AP, Brier and Brier skill per run of scored rows."""
    return f"""tied AS (SELECT {keys}, score, sum(label) AS p, count(*) - sum(label) AS q FROM {oof} GROUP BY {keys}, score),
curve AS (SELECT *, sum(p) OVER (w ORDER BY score DESC) AS pu, sum(q) OVER (w ORDER BY score DESC) AS qu FROM tied WINDOW w AS (PARTITION BY {keys})),
ranks AS (SELECT {keys}, sum(q * (pu - p / 2.0::DOUBLE)) / (sum(p) * sum(q))::DOUBLE AS auc, sum(p * pu / (pu + qu)::DOUBLE) / sum(p) AS ap FROM curve GROUP BY {keys}),
loss AS (SELECT {keys}, avg(pow(score - label, 2)) AS brier, avg(label) AS prevalence FROM {oof} GROUP BY {keys}),
facts AS (SELECT *, 1 - brier / (prevalence * (1 - prevalence)) AS bss FROM ranks JOIN loss USING ({keys}))"""


def hazard(rows: str, features: int, name: str = "hz", *, penalty: float = 0.1, steps: int = 500) -> str:
    """CTEs to `<name>` (key, n, events, w0..): maximum of the partial likelihood with evenly spread ties, less n * penalty / 2 * |w|^2.

    `rows` has key, days, d (event) and standardised z0... Gradient steps; risk sets are running sums from the last day back.
    """
    k = range(features)
    line = " + ".join(f"w{i} * z{i}" for i in k)
    kept = ", ".join(f"w{i}" for i in k)
    held = ", ".join(f"any_value(w{i}) AS w{i}" for i in k)
    by_day = ", ".join([*[f"sum(r * z{i}) AS a{i}, sum(d * r * z{i}) AS e{i}, sum(d * z{i}) AS x{i}" for i in k]])
    running = ", ".join(f"sum(a{i}) OVER w AS s{i}" for i in k)
    carried = ", ".join(f"e{i}, x{i}" for i in k)
    gradient = ", ".join(f"sum(x{i} / d - (s{i} - l / d * e{i}) / (s - l / d * e)) AS g{i}" for i in k)
    moved = ", ".join(f"w{i} + (g{i} - n * {penalty} * w{i}) / (n * 1.5) AS w{i}" for i in k)
    return f"""{name}_gd AS (SELECT key, 0 AS step, count(*)::DOUBLE AS n, sum(d) AS events, {", ".join(f"0.0::DOUBLE AS w{i}" for i in k)} FROM {rows} GROUP BY key
  UNION ALL SELECT key, step + 1, n, events, {moved} FROM (
    SELECT key, step, any_value(n) AS n, any_value(events) AS events, {held}, {gradient} FROM (
      SELECT key, step, n, events, {kept}, d::DOUBLE AS d, s, e, {", ".join(f"s{i}" for i in k)}, {carried}, unnest(range(d::BIGINT))::DOUBLE AS l FROM (
        SELECT key, step, n, events, {kept}, d, e, {carried}, sum(a) OVER w AS s, {running} FROM (
          SELECT key, step, days, any_value(n) AS n, any_value(events) AS events, {held}, sum(d) AS d, sum(r) AS a, sum(d * r) AS e, {by_day} FROM (
            SELECT g.*, days, d, {", ".join(f"z{i}" for i in k)}, exp({line}) AS r FROM {name}_gd g JOIN {rows} USING (key)) GROUP BY key, step, days)
        WINDOW w AS (PARTITION BY key, step ORDER BY days DESC)) WHERE d > 0) GROUP BY key, step) WHERE step < {steps}),
{name} AS (SELECT * FROM {name}_gd WHERE step = {steps})"""
