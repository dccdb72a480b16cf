"""The registered queries once more, in SQL that DuckDB runs on the same tables, to check them against."""

from __future__ import annotations

from ..functions import COARSE, HALF
from ..operators.decisions import WEIGHTS
from .queries import AS_OF, CENTRE, CUT_3M, CUT_6M, GATE, MONTHS, RISKY, V1, V2, V3

_ACCT = "'ACCT_' || lpad(CAST({} AS VARCHAR), 6, '0')"
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

VIEWS = {
    "txn_a": f"""SELECT {_ACCT.format("o_custkey")} AS account_id,
      CASE WHEN l_linenumber = 7 THEN NULL WHEN l_partkey % 2 = 0 THEN {_ACCT.format("l_partkey")} ELSE 'EXT_' || l_suppkey END AS counterparty_id,
      CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS amount, CASE WHEN l_linestatus = 'O' THEN 'C' ELSE 'D' END AS txn_type,
      o_orderpriority AS channel, p_brand AS mcc_code, l_shipdate AS ts, l_quantity * 100 AS round_amount
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "txn_b": f"""SELECT event_id AS transaction_id, {_ACCT.format("user_id")} AS account_id, CASE WHEN {_K} <> 0 THEN {_ACCT.format(_K)} END AS counterparty_id,
      CASE WHEN event_type = 'error' THEN -value ELSE value END AS amount, CASE WHEN event_type IN ('purchase', 'signup') THEN 'C' WHEN event_type IN ('view', 'click') THEN 'D' END AS txn_type,
      event_type AS channel, {_K} % 10 AS mcc_code, ts, floor(value) * 100 * (CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) AS scaled_amount FROM events""",
    "add_b": f"""SELECT event_id AS transaction_id, CASE WHEN {_K} % 7 <> 0 THEN value * 10 - 200 END AS balance, CASE WHEN {_K} % 11 <> 0 THEN 'ip_' || {_K} END AS ip,
      CASE WHEN {_K} % 10 <> 0 THEN CAST({_K} - 50 AS DOUBLE) END AS lat, CASE WHEN {_K} % 10 <> 0 THEN CAST(2 * {_K} - 100 AS DOUBLE) END AS lon,
      CASE WHEN event_type = 'error' THEN 'special' ELSE 'normal' END AS sub_type, event_type AS part_type FROM events""",
    "joined_b": "SELECT t.account_id, a.* FROM txn_b t JOIN add_b a USING (transaction_id)",
    "labels_": f"SELECT {_ACCT.format('c_custkey')} AS account_id, CAST(c_acctbal < 0 AS INTEGER) AS is_mule FROM customer WHERE c_custkey % 5 >= 2",
    "folds": "SELECT *, (row_number() OVER (PARTITION BY is_mule ORDER BY md5(account_id)) - 1) % 5 AS fold FROM labels_",
    "accts": f"SELECT {_ACCT.format('c_custkey')} AS account_id FROM customer",
    "prior_": "SELECT avg(CAST(is_mule AS DOUBLE)) AS prior FROM labels_",
    "scores": f"SELECT {_ACCT.format('c_custkey')} AS account_id, CAST(c_custkey * 37 % 101 AS DOUBLE) / 100 AS s1, CAST(c_custkey * 53 % 97 AS DOUBLE) / 96 AS s2 FROM customer",
    "daily_a": """SELECT account_id, CAST(ts AS DATE) AS day, sum(abs(amount)) AS daily_vol, count(*) AS daily_txns, coalesce(sum(abs(amount)) FILTER (WHERE txn_type = 'C'), 0) AS daily_in,
      coalesce(sum(abs(amount)) FILTER (WHERE txn_type = 'D'), 0) AS daily_out FROM txn_a GROUP BY ALL""",
    "daily_b": """SELECT account_id, CAST(ts AS DATE) AS day, sum(abs(amount)) AS daily_vol, count(*) AS daily_txns, coalesce(sum(abs(amount)) FILTER (WHERE txn_type = 'C'), 0) AS daily_in,
      coalesce(sum(abs(amount)) FILTER (WHERE txn_type = 'D'), 0) AS daily_out FROM txn_b GROUP BY ALL""",
    "ranked": """SELECT *, (r1 + r2) / 2 AS rank_blend FROM (SELECT *, (rank() OVER (ORDER BY s1) + (count(*) OVER (PARTITION BY s1) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER () AS r1,
      (rank() OVER (ORDER BY s2) + (count(*) OVER (PARTITION BY s2) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER () AS r2 FROM scores)""",
    "iat_b": "SELECT account_id, CAST(datesub('second', lag(ts) OVER (PARTITION BY account_id ORDER BY ts), ts) AS DOUBLE) AS iat FROM txn_b",
    "bursts": "SELECT account_id, count(*) FILTER (WHERE iat < 300) AS burst FROM iat_b GROUP BY 1",
    "basic_a": "SELECT account_id, sum(abs(amount)) AS total_volume, count(*) AS total_txns FROM txn_a GROUP BY 1",
    "pairs_a": "SELECT account_id, counterparty_id, count(*) AS n, sum(abs(amount)) AS v FROM txn_a GROUP BY ALL",
    "edges": """SELECT e.*, CAST(coalesce(m.is_mule, 0) AS INTEGER) AS am, CAST(coalesce(c.is_mule, 0) AS INTEGER) AS cm FROM (SELECT account_id, counterparty_id, amount FROM txn_a WHERE counterparty_id IS NOT NULL) e
      LEFT JOIN labels_ m ON m.account_id = e.account_id LEFT JOIN labels_ c ON c.account_id = e.counterparty_id""",
    "mule_nb": "SELECT account_id, count(*) AS n_mule_counterparties FROM (SELECT account_id, counterparty_id AS o FROM edges WHERE cm = 1 UNION SELECT counterparty_id, account_id FROM edges WHERE am = 1) GROUP BY 1",
    "filled": """SELECT s.account_id, s.day, coalesce(d.daily_vol, 0) AS v FROM (SELECT account_id, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM daily_b GROUP BY 1) s
      LEFT JOIN daily_b d USING (account_id, day)""",
    "smooth": "SELECT *, avg(v) OVER (PARTITION BY account_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM filled",
    "levels": """SELECT account_id, CASE WHEN median(v) > 0 THEN median(v) WHEN avg(v) > 0 THEN avg(v) ELSE 1 END AS base, min(day) AS lo, max(day) AS hi FROM filled GROUP BY 1""",
    "peaks": "SELECT account_id, day AS peak FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY m DESC, day) AS r FROM smooth) WHERE r = 1",
    "peak_w": """SELECT l.account_id, coalesce(max(s.day) FILTER (WHERE s.m < l.base AND s.day < p.peak) + 1, any_value(l.lo)) AS suspicious_start, coalesce(min(s.day) FILTER (WHERE s.m < l.base AND s.day > p.peak), any_value(l.hi) + 1) AS suspicious_end
      FROM levels l JOIN peaks p USING (account_id) JOIN smooth s USING (account_id) GROUP BY 1""",
    "flag3": "SELECT account_id FROM scores WHERE s1 >= (SELECT quantile_cont(s1, CAST(0.7 AS DOUBLE)) FROM scores)",
    "life": "SELECT account_id, min(ts) AS suspicious_start, max(ts) AS suspicious_end FROM txn_b WHERE account_id IN (SELECT account_id FROM flag3) GROUP BY 1",
    "zscores": """SELECT account_id, coalesce(max(z), 0) AS zmax, coalesce(avg(z), 0) AS zmean FROM (SELECT account_id, CASE WHEN count(daily_vol) OVER w >= 2 THEN (daily_vol - avg(daily_vol) OVER w) / (stddev_samp(daily_vol) OVER w + CAST(1e-9 AS DOUBLE)) END AS z FROM daily_b
      WINDOW w AS (PARTITION BY account_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) GROUP BY 1""",
    "entropy": "SELECT account_id, -sum(CAST(n AS DOUBLE) / t * log2(CAST(n AS DOUBLE) / t)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY account_id) AS t FROM pairs_a) GROUP BY 1",
    "months": "SELECT account_id, strftime(ts, '%Y-%m') AS month, count(*) AS n, sum(abs(amount)) AS v, max(abs(amount)) AS x FROM txn_a GROUP BY ALL",
    "degrees": """SELECT account_id, count(DISTINCT counterparty_id) FILTER (WHERE txn_type = 'D') AS od, count(DISTINCT counterparty_id) FILTER (WHERE txn_type = 'C') AS id, count(*) FILTER (WHERE txn_type = 'D') AS oc, count(*) FILTER (WHERE txn_type = 'C') AS ic,
      coalesce(sum(abs(amount)) FILTER (WHERE txn_type = 'D'), 0) AS ov, coalesce(sum(abs(amount)) FILTER (WHERE txn_type = 'C'), 0) AS iv FROM txn_a WHERE counterparty_id IS NOT NULL GROUP BY 1""",
    "opened": f"SELECT {_ACCT.format('o_custkey')} AS account_id, CAST(min(o_orderdate) AS DATE) AS opening FROM orders GROUP BY 1",
}


def _q(x: str) -> str:
    d = "CAST({} AS DOUBLE)".format
    x = d(x)
    parts = [f"WHEN abs({x}) < 1e9 THEN floor({x} * {d('1e6')} + {d(HALF)}) / {d('1e6')}", f"WHEN abs({x}) < 1e10 THEN floor({x} * {d(10)} + {d(HALF)}) / {d(10)}"]
    for k in COARSE[1:]:
        step = d(f"1e{k - 10}")
        parts.append(f"WHEN abs({x}) < 1e{k + 1} THEN floor({x} / {step} + {d(HALF)}) * {step}")
    return f"(CASE {' '.join(parts)} ELSE {x} END + {d(0)})"


class Sql(str):
    """A query whose doubles are rounded, with the parts it was made of."""

    body: str
    doubles: str
    longs: str


def _sql(body: str, doubles: str = "", longs: str = "") -> Sql:
    """body over the views above that it names, directly or through each other; doubles quantised, longs cast."""
    import re

    used: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in used and re.search(rf"\b{name}\b", text):
                need(VIEWS[name])
                if name not in used:
                    used.append(name)

    need(body)
    swap = [f"{_q(c)} AS {c}" for c in doubles.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]
    head = ("WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in used) + " ") if used else ""
    out = Sql(f"{head}SELECT * {'REPLACE (' + ', '.join(swap) + ')' if swap else ''} FROM ({body})")
    out.body, out.doubles, out.longs = body, doubles, longs
    return out


def _r(a: str, b: str, add: str = "1e-9") -> str:
    return f"(CAST({a} AS DOUBLE) / (CAST({b} AS DOUBLE) + CAST({add} AS DOUBLE)))"


def _te(keys: list[str], alpha: float) -> str:
    """Each transaction with its encoding; other than by the engine's joins, the fold's share is taken off a window's total."""
    on = " AND ".join(f"t.{k} = {{}}.{k}" for k in keys)
    k = ", ".join(keys)
    return f"""SELECT t.account_id, t.amount, coalesce((g.s - coalesce(f.s, 0) + {alpha} * p.prior) / (g.n - coalesce(f.n, 0) + {alpha}), p.prior) AS te
      FROM txn_a t LEFT JOIN folds l ON l.account_id = t.account_id CROSS JOIN prior_ p
      LEFT JOIN (SELECT {k}, CAST(sum(is_mule) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM txn_a JOIN folds USING (account_id) GROUP BY ALL) g ON {on.format(*["g"] * len(keys))}
      LEFT JOIN (SELECT {k}, fold, CAST(sum(is_mule) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM txn_a JOIN folds USING (account_id) GROUP BY ALL) f ON {on.format(*["f"] * len(keys))} AND f.fold = l.fold"""


def _oof(keys: list[str], alpha: float, tag: str) -> str:
    names = ["mean", "std", "max", "amt_weighted", "high_risk_ratio"]
    return _sql(
        f"""SELECT c.account_id, {", ".join(f"coalesce({n}_, prior) AS te_{tag}_{n}" for n in names)} FROM accts c CROSS JOIN prior_ LEFT JOIN (
      SELECT account_id, avg(te) AS mean_, sqrt(greatest(0, avg(te * te) - avg(te) * avg(te))) AS std_, max(te) AS max_, sum(amount * te) / (sum(amount) + CAST(1e-9 AS DOUBLE)) AS amt_weighted_,
      avg(CASE WHEN te >= {RISKY} THEN CAST(1 AS DOUBLE) ELSE 0 END) AS high_risk_ratio_ FROM ({_te(keys, alpha)}) GROUP BY 1) a USING (account_id)""",
        " ".join(f"te_{tag}_{n}" for n in names),
    )


def _family(keys: list[str], alpha: float, tag: str) -> str:
    names = ["mean", "max", "std", "amtw"]
    return _sql(
        f"""SELECT c.account_id, {", ".join(f"coalesce({n}_, prior) AS te_{tag}_{n}" for n in names)} FROM accts c CROSS JOIN prior_ LEFT JOIN (
      SELECT account_id, avg(te) AS mean_, max(te) AS max_, stddev_samp(te) AS std_, sum(amount * te) / (sum(amount) + CAST(1e-9 AS DOUBLE)) AS amtw_ FROM ({_te(keys, alpha)}) GROUP BY 1) a USING (account_id)""",
        " ".join(f"te_{tag}_{n}" for n in names),
    )


_NIGHT = "(extract(hour FROM ts) >= 22 OR extract(hour FROM ts) < 6)"
_R3, _R6 = f"CAST(ts AS DATE) >= DATE '{CUT_3M}'", f"CAST(ts AS DATE) >= DATE '{CUT_6M}'"
_NU = "count(DISTINCT {0}) + max(CASE WHEN {0} IS NULL THEN 1 ELSE 0 END)"


def _patterns(view: str, amount: str) -> str:
    return _sql(
        f"""SELECT *, {_r("night_txn_count", "n_txns")} AS night_txn_ratio, {_r("weekend_txn_count", "n_txns")} AS weekend_txn_ratio, {_r("round_1k_count", "n_txns")} AS round_1k_ratio FROM (
      SELECT account_id, count(*) AS n_txns, count(*) FILTER (WHERE {_NIGHT}) AS night_txn_count, count(*) FILTER (WHERE isodow(ts) >= 5) AS weekend_txn_count, count(*) FILTER (WHERE abs({amount}) % 1000 = 0) AS round_1k_count,
      count(*) FILTER (WHERE abs({amount}) >= 45000 AND abs({amount}) < 50000) AS structuring_count, {_NU.format("mcc_code")} AS n_mcc_codes FROM {view} GROUP BY 1)""",
        "night_txn_ratio weekend_txn_ratio round_1k_ratio",
        "n_txns night_txn_count weekend_txn_count round_1k_count structuring_count n_mcc_codes",
    )


_BAL = f"""SELECT *, balance_max - balance_min AS balance_range, {_r("near_zero_balance_count", "n_balance_txns")} AS near_zero_ratio, balance_std / (abs(balance_mean) + CAST(1e-9 AS DOUBLE)) AS balance_cv FROM (
  SELECT account_id, stddev_samp(balance) AS balance_std, min(balance) AS balance_min, max(balance) AS balance_max, avg(balance) AS balance_mean, count(*) FILTER (WHERE abs(balance) < 100) AS near_zero_balance_count,
  count(*) FILTER (WHERE balance < 0) AS negative_balance_count, count(*) AS n_balance_txns FROM joined_b WHERE balance IS NOT NULL GROUP BY 1)"""
_IP = f"SELECT *, {_r('n_unique_ips', 'n_ip_txns')} AS ip_per_txn_ratio FROM (SELECT account_id, count(DISTINCT ip) AS n_unique_ips, count(*) AS n_ip_txns FROM joined_b WHERE ip IS NOT NULL GROUP BY 1)"
_GEO = """SELECT *, sqrt((lat_max - lat_min) ** 2 + (lon_max - lon_min) ** 2) AS geo_spread FROM (SELECT account_id, stddev_samp(lat) AS lat_std, stddev_samp(lon) AS lon_std, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max
  FROM joined_b WHERE lat IS NOT NULL GROUP BY 1)"""
_BAL_D, _BAL_L = "balance_std balance_min balance_max balance_mean balance_range near_zero_ratio balance_cv", "near_zero_balance_count negative_balance_count n_balance_txns"
_GEO_D = "lat_std lon_std lat_min lat_max lon_min lon_max geo_spread"


def _pass(version: int) -> str:
    return f"SELECT account_id, coalesce(sum(least(daily_in, daily_out)) / (sum({'daily_vol' if version == 1 else 'greatest(daily_in, daily_out)'}) + CAST(1e-9 AS DOUBLE)), 0) AS pass_through_ratio FROM {{}} GROUP BY 1"


def _matrix(q: dict[str, Sql], features: list, more: str = "", more_doubles: str = "") -> Sql:
    """The feature tables' queries, not rounded yet, joined to the encoded master."""
    codes = ", ".join(f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}" for c in ("branch_name", "branch_region", "account_segment", "segment"))
    master = f"""SELECT account_id, account_count_per_customer, n_products, income_band, account_age_days, customer_age_days, was_frozen, kyc_flag, {codes} FROM ({q["account_master"].body})
      JOIN (SELECT {_ACCT.format("c_custkey")} AS account_id, c_acctbal > 5000 AS kyc_flag, c_mktsegment AS segment FROM customer) USING (account_id)"""
    parts = [q[f.__name__] for f in features]
    joins = " ".join(f"LEFT JOIN ({x.body}) USING (account_id)" for x in parts)
    longs = "account_count_per_customer n_products income_band account_age_days customer_age_days was_frozen kyc_flag branch_name branch_region account_segment segment"
    return _sql(f"SELECT *{', ' + more if more else ''} FROM ({master}) {joins}", " ".join([*(x.doubles for x in parts), more_doubles]), " ".join([longs, *(x.longs for x in parts)]))


def _auc(score: str, rows: str) -> str:
    return f"""(SELECT (sum(is_mule * r) - sum(is_mule) * (sum(is_mule) + 1) / CAST(2 AS DOUBLE)) / nullif(sum(is_mule) * (count(*) - sum(is_mule)), 0) FROM (
      SELECT is_mule, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / CAST(2 AS DOUBLE) AS r FROM {rows}))"""


_LABELLED = "(SELECT s.*, is_mule FROM scores s JOIN labels_ USING (account_id))"
_FRACS = [("vol", "sent"), ("vol", "recv"), ("txn", "sent"), ("txn", "recv")]
_SIDES = [f"{k}_{s}{m}" for s in ("sent", "recv") for k, m in (("vol", ""), ("txn", ""), ("vol", "_mule"), ("txn", "_mule"))]


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["txn_basic"] = _sql(
        f"""SELECT *, total_volume / total_txns AS avg_txn_amount, CAST(reversal_count AS DOUBLE) / total_txns AS reversal_ratio, {_r("credit_volume", "credit_volume + debit_volume")} AS credit_debit_ratio,
      max_txn_amount / (total_volume / total_txns + CAST(1e-9 AS DOUBLE)) AS max_to_avg_ratio FROM (SELECT account_id, sum(abs(amount)) AS total_volume, sum(amount * amount) AS sum_sq_amount, count(*) AS total_txns, max(abs(amount)) AS max_txn_amount, min(abs(amount)) AS min_txn_amount,
      count(*) FILTER (WHERE amount < 0) AS reversal_count, count(*) FILTER (WHERE txn_type = 'C') AS credit_count, count(*) FILTER (WHERE txn_type = 'D') AS debit_count, coalesce(sum(abs(amount)) FILTER (WHERE txn_type = 'C'), 0) AS credit_volume,
      coalesce(sum(abs(amount)) FILTER (WHERE txn_type = 'D'), 0) AS debit_volume, {_NU.format("channel")} AS n_channels, {_NU.format("counterparty_id")} AS n_counterparties FROM txn_a WHERE account_id IN (SELECT account_id FROM accts) GROUP BY 1)""",
        "total_volume sum_sq_amount max_txn_amount min_txn_amount credit_volume debit_volume avg_txn_amount reversal_ratio credit_debit_ratio max_to_avg_ratio",
        "total_txns reversal_count credit_count debit_count n_channels n_counterparties",
    )
    q["txn_basic_batched"] = _sql(
        f"""SELECT account_id, sum(v) AS total_volume, sum(q) AS sum_sq_amount, sum(n) AS total_txns, max(x) AS max_txn_amount, min(m) AS min_txn_amount, sum(r) AS reversal_count, sum(c) AS credit_count, sum(d) AS debit_count, sum(cv) AS credit_volume, sum(dv) AS debit_volume, max(nc) AS n_channels, max(np) AS n_counterparties FROM (
      SELECT account_id, year(ts) % 4 AS b, sum(abs(amount)) AS v, sum(amount * amount) AS q, count(*) AS n, max(abs(amount)) AS x, min(abs(amount)) AS m, count(*) FILTER (WHERE amount < 0) AS r, count(*) FILTER (WHERE txn_type = 'C') AS c, count(*) FILTER (WHERE txn_type = 'D') AS d,
      coalesce(sum(abs(amount)) FILTER (WHERE txn_type = 'C'), 0) AS cv, coalesce(sum(abs(amount)) FILTER (WHERE txn_type = 'D'), 0) AS dv, {_NU.format("channel")} AS nc, {_NU.format("counterparty_id")} AS np FROM txn_a GROUP BY ALL) GROUP BY 1""",
        "total_volume sum_sq_amount max_txn_amount min_txn_amount credit_volume debit_volume",
        "total_txns reversal_count credit_count debit_count n_channels n_counterparties",
    )
    q["iat_burst_batched"] = _sql(
        """SELECT account_id, avg(a) AS iat_mean, avg(s) AS iat_std, avg(md) AS iat_median, min(mi) AS iat_min, sum(b1) AS burst_count_60s, sum(b5) AS burst_count_5min FROM (SELECT account_id, b, avg(iat) AS a, stddev_samp(iat) AS s, median(iat) AS md, min(iat) AS mi, count(*) FILTER (WHERE iat < 60) AS b1,
      count(*) FILTER (WHERE iat < 300) AS b5 FROM (SELECT account_id, day(ts) % 2 AS b, CAST(datesub('second', lag(ts) OVER (PARTITION BY account_id, day(ts) % 2 ORDER BY ts), ts) AS DOUBLE) AS iat FROM txn_b) GROUP BY ALL) GROUP BY 1""",
        "iat_mean iat_std iat_median",
        "iat_min burst_count_60s burst_count_5min",
    )
    q["account_master"] = _sql(
        f"""SELECT {_ACCT.format("c_custkey")} AS account_id, c_custkey // 2 AS customer_id, count(*) OVER (PARTITION BY c_custkey // 2) AS account_count_per_customer, c_nationkey AS branch_code, n_name AS branch_name, r_name AS branch_region,
      (c_custkey // 2) % 3 AS n_products, (c_custkey // 2) % 7 AS income_band, c_mktsegment AS account_segment, date_diff('day', opening, DATE '{AS_OF}') AS account_age_days,
      date_diff('day', DATE '1950-01-01' + CAST((c_custkey // 2) % 15000 AS INTEGER), DATE '{AS_OF}') AS customer_age_days, c_acctbal < -500 AS was_frozen
      FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN opened ON opened.account_id = {_ACCT.format("c_custkey")}""",
        longs="customer_id account_count_per_customer branch_code n_products income_band account_age_days customer_age_days was_frozen",
    )
    q["txn_additional_balance"] = _sql(_BAL, _BAL_D, _BAL_L)
    q["txn_additional_ip"] = _sql(_IP, "ip_per_txn_ratio", "n_unique_ips n_ip_txns")
    q["txn_additional_geo"] = _sql(_GEO, _GEO_D)
    q["txn_additional"] = _sql(f"SELECT * FROM ({_BAL}) b FULL JOIN ({_IP}) i USING (account_id) FULL JOIN ({_GEO}) g USING (account_id)", f"{_BAL_D} ip_per_txn_ratio {_GEO_D}", f"{_BAL_L} n_unique_ips n_ip_txns")
    q["oof_te_counterparty"] = _oof(["counterparty_id"], 50, "counterparty")
    q["oof_te_mcc"] = _oof(["mcc_code"], 20, "mcc")
    q["oof_te_channel"] = _oof(["channel"], 20, "channel")
    q["oof_te_pair"] = _oof(["counterparty_id", "channel"], 60, "pair")
    q["te_family_txntype"] = _family(["txn_type"], 20, "txntype")
    q["te_family_mcc_txn"] = _family(["mcc_code", "txn_type"], 40, "mcc_txn")
    q["te_family_cp_txn"] = _family(["counterparty_id", "txn_type"], 50, "cp_txn")
    q["te_full_table"] = _sql(
        """SELECT g.counterparty_id, g.fold, (g.s - coalesce(f.s, 0) + 50 * prior) / (g.n - coalesce(f.n, 0) + 50) AS te FROM (
      SELECT counterparty_id, CAST(sum(is_mule) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n, unnest([-1, 0, 1, 2, 3, 4]) AS fold FROM txn_a JOIN folds USING (account_id) GROUP BY 1) g CROSS JOIN prior_
      LEFT JOIN (SELECT counterparty_id, fold, sum(is_mule) AS s, count(*) AS n FROM txn_a JOIN folds USING (account_id) GROUP BY ALL) f ON f.counterparty_id IS NOT DISTINCT FROM g.counterparty_id AND f.fold = g.fold""",
        "te",
        "fold",
    )
    q["fold_assignment"] = _sql("SELECT * FROM folds", longs="is_mule fold")
    q["cp_totals"] = _sql(f"SELECT counterparty_id, {_NU.format('account_id')} AS cp_n_accounts, count(*) AS cp_total_txns FROM txn_a GROUP BY 1", longs="cp_n_accounts cp_total_txns")
    q["cp_frequency"] = _sql(
        """SELECT c.account_id, coalesce(m, 0) AS cp_freq_mean, coalesce(x, 0) AS cp_freq_max, coalesce(n, 0) AS cp_freq_min, coalesce(s, 0) AS cp_freq_std, coalesce(e, 0) AS cp_exclusive_cnt FROM accts c LEFT JOIN (
      SELECT account_id, avg(k) AS m, max(k) AS x, min(k) AS n, stddev_samp(k) AS s, count(*) FILTER (WHERE k = 1) AS e FROM txn_a LEFT JOIN (SELECT counterparty_id, count(DISTINCT account_id) AS k FROM txn_a GROUP BY 1) p USING (counterparty_id) GROUP BY 1) a USING (account_id)""",
        "cp_freq_mean cp_freq_std",
        "cp_freq_max cp_freq_min cp_exclusive_cnt",
    )
    q["mule_ip_exposure"] = _sql(
        f"""SELECT c.account_id, coalesce(k, 0) AS mule_ip_txns, coalesce({_r("k", "n", "1")}, 0) AS mule_ip_ratio FROM accts c LEFT JOIN (SELECT account_id, count(*) AS n, count(*) FILTER (WHERE ip IN (
      SELECT ip FROM joined_b JOIN labels_ USING (account_id) WHERE is_mule = 1 AND ip IS NOT NULL)) AS k FROM joined_b WHERE ip IS NOT NULL GROUP BY 1) a USING (account_id)""",
        "mule_ip_ratio",
        "mule_ip_txns",
    )
    q["txn_subtypes"] = _sql(
        f"""SELECT c.account_id, coalesce(a, 0) AS n_sub_types, coalesce(b, 0) AS n_part_types, coalesce(s, 0) AS special_txn_cnt, coalesce({_r("s", "n", "1")}, 0) AS special_txn_ratio FROM accts c LEFT JOIN (SELECT account_id, count(*) AS n,
      {_NU.format("sub_type")} AS a, {_NU.format("part_type")} AS b, count(*) FILTER (WHERE sub_type <> 'normal') AS s FROM joined_b GROUP BY 1) x USING (account_id)""",
        "special_txn_ratio",
        "n_sub_types n_part_types special_txn_cnt",
    )
    q["neighbor_risk"] = _sql(
        f"""SELECT *, {_r("neighbor_score_weighted_sum", "neighbor_score_count", "1e-3")} AS neighbor_score_weighted_mean FROM (SELECT t.account_id, avg(s1) AS neighbor_score_mean, max(s1) AS neighbor_score_max, count(*) AS neighbor_score_count,
      sum(s1 * abs(amount)) AS neighbor_score_weighted_sum FROM txn_a t JOIN scores s ON t.counterparty_id = s.account_id GROUP BY 1)""",
        "neighbor_score_mean neighbor_score_max neighbor_score_weighted_sum neighbor_score_weighted_mean",
        "neighbor_score_count",
    )
    sums = ["recent_3m_vol", "recent_6m_vol", "recent_3m_credit_vol", "recent_3m_debit_vol"]
    counts = ["recent_3m_txns", "recent_6m_txns", "recent_3m_night_txns", "recent_3m_round_1k_count", "recent_3m_unique_cp"]
    q["recency"] = _sql(
        f"""SELECT * EXCLUDE (v, n), {_r("recent_3m_vol", "v")} AS recent_vol_ratio, {_r("recent_3m_txns", "n", "1")} AS recent_txn_ratio, recent_3m_txns > 0 AS is_active_recent, {_r("recent_3m_vol", "recent_6m_vol - recent_3m_vol")} AS vol_acceleration,
      {_r("recent_3m_unique_cp", "recent_3m_txns", "1")} AS recent_cp_ratio, {_r("recent_3m_night_txns", "recent_3m_txns", "1")} AS recent_night_ratio, {_r("recent_3m_round_1k_count", "recent_3m_txns", "1")} AS recent_round_1k_ratio FROM (
      SELECT c.account_id, {", ".join(f"coalesce({x}, 0) AS {x}" for x in ["v", "n", *sums, *counts])} FROM accts c LEFT JOIN (SELECT account_id, sum(abs(amount)) AS v, count(*) AS n, sum(abs(amount)) FILTER (WHERE {_R3}) AS recent_3m_vol,
      sum(abs(amount)) FILTER (WHERE {_R6}) AS recent_6m_vol, sum(amount) FILTER (WHERE {_R3} AND amount > 0) AS recent_3m_credit_vol, sum(-amount) FILTER (WHERE {_R3} AND amount < 0) AS recent_3m_debit_vol, count(*) FILTER (WHERE {_R3}) AS recent_3m_txns,
      count(*) FILTER (WHERE {_R6}) AS recent_6m_txns, count(*) FILTER (WHERE {_R3} AND {_NIGHT}) AS recent_3m_night_txns, count(*) FILTER (WHERE {_R3} AND abs(amount) % 1000 = 0) AS recent_3m_round_1k_count,
      count(DISTINCT counterparty_id) FILTER (WHERE {_R3}) + max(CASE WHEN {_R3} AND counterparty_id IS NULL THEN 1 ELSE 0 END) AS recent_3m_unique_cp FROM txn_a GROUP BY 1) a USING (account_id))""",
        " ".join([*sums, "recent_vol_ratio recent_txn_ratio vol_acceleration recent_cp_ratio recent_night_ratio recent_round_1k_ratio"]),
        " ".join([*counts, "is_active_recent"]),
    )
    q["daily_volume"] = _sql("SELECT * FROM daily_a", "daily_vol daily_in daily_out", "daily_txns")
    q["rolling_7d_zscore"] = _sql("SELECT account_id, zmax AS rolling_7d_zscore_max, zmean AS rolling_7d_zscore_mean FROM zscores", "rolling_7d_zscore_max rolling_7d_zscore_mean")
    q["cp_entropy"] = _sql("SELECT account_id, greatest(0, h) AS cp_entropy FROM entropy", "cp_entropy")
    q["days_to_first_txn"] = _sql("SELECT account_id, greatest(coalesce(date_diff('day', opening, CAST(f AS DATE)), 999), 0) AS days_to_first_txn FROM (SELECT account_id, min(ts) AS f FROM txn_a GROUP BY 1) JOIN accts USING (account_id) LEFT JOIN opened USING (account_id)", longs="days_to_first_txn")
    q["turnover_ratio"] = _sql("SELECT account_id, coalesce(v / (abs(m) + 1), 0) AS turnover_ratio FROM (SELECT account_id, sum(abs(amount)) AS v FROM txn_b GROUP BY 1) LEFT JOIN (SELECT account_id, avg(balance) AS m FROM joined_b GROUP BY 1) USING (account_id)", "turnover_ratio")
    q["peak_day_conc"] = _sql(f"SELECT account_id, {_r('max(daily_txns)', 'sum(daily_txns)')} AS peak_day_conc_txn, {_r('max(daily_vol)', 'sum(daily_vol)')} AS peak_day_conc_vol FROM daily_a GROUP BY 1", "peak_day_conc_txn peak_day_conc_vol")
    q["pass_through_v1"] = _sql(_pass(1).format("daily_b"), "pass_through_ratio")
    q["pass_through_v2"] = _sql(_pass(2).format("daily_b"), "pass_through_ratio")
    q["iat_burst"] = _sql(
        "SELECT account_id, avg(iat) AS iat_mean, stddev_samp(iat) AS iat_std, min(iat) AS iat_min, median(iat) AS iat_median, count(*) FILTER (WHERE iat < 60) AS burst_count_60s, count(*) FILTER (WHERE iat < 300) AS burst_count_5min FROM iat_b GROUP BY 1",
        "iat_mean iat_std iat_median",
        "iat_min burst_count_60s burst_count_5min",
    )
    q["temporal_patterns"] = _patterns("txn_b", "scaled_amount")
    q["round_amounts"] = _patterns("txn_a", "round_amount")
    q["monthly_behavior"] = _sql(
        f"""SELECT *, {_r("monthly_vol_max", "monthly_vol_mean")} AS vol_spike_ratio, {_r("monthly_txns_max", "monthly_txns_mean")} AS txn_spike_ratio, {_r("monthly_vol_std", "monthly_vol_mean")} AS monthly_vol_cv, {MONTHS} - n_active_months AS n_dormant_months FROM (
      SELECT account_id, count(*) AS n_active_months, avg(v) AS monthly_vol_mean, stddev_samp(v) AS monthly_vol_std, max(v) AS monthly_vol_max, min(v) AS monthly_vol_min, avg(n) AS monthly_txns_mean, stddev_samp(n) AS monthly_txns_std, max(n) AS monthly_txns_max,
      max(x) AS peak_monthly_max_txn FROM months GROUP BY 1)""",
        "monthly_vol_mean monthly_vol_std monthly_vol_max monthly_vol_min monthly_txns_mean monthly_txns_std peak_monthly_max_txn vol_spike_ratio txn_spike_ratio monthly_vol_cv",
        "n_active_months monthly_txns_max n_dormant_months",
    )
    q["passthrough_hours"] = _sql(
        """SELECT account_id, count(*) FILTER (WHERE nc > 0 AND nd > 0) AS passthrough_hours, count(*) FILTER (WHERE nc > 0 AND nd > 0 AND abs(vc - vd) / (vc + CAST(1e-9 AS DOUBLE)) < 0.2) AS matched_passthrough_hours FROM (
      SELECT account_id, date_trunc('hour', ts) AS h, count(*) FILTER (WHERE txn_type = 'C') AS nc, count(*) FILTER (WHERE txn_type = 'D') AS nd, coalesce(sum(abs(amount)) FILTER (WHERE txn_type = 'C'), 0) AS vc, coalesce(sum(abs(amount)) FILTER (WHERE txn_type = 'D'), 0) AS vd
      FROM txn_b GROUP BY ALL) GROUP BY 1""",
        longs="passthrough_hours matched_passthrough_hours",
    )
    q["cp_concentration"] = _sql(
        f"""SELECT *, {_r("top_cparty_txn_count", "total_cparty_txns")} AS top_cparty_concentration, {_r("top_cparty_volume", "total_cparty_volume")} AS top_cparty_volume_share FROM (SELECT account_id, max(n) AS top_cparty_txn_count, max(v) AS top_cparty_volume,
      sum(n) AS total_cparty_txns, sum(v) AS total_cparty_volume, count(*) AS n_unique_counterparties FROM pairs_a WHERE counterparty_id IS NOT NULL GROUP BY 1)""",
        "top_cparty_volume total_cparty_volume top_cparty_concentration top_cparty_volume_share",
        "top_cparty_txn_count total_cparty_txns n_unique_counterparties",
    )
    q["activity_span"] = _sql("SELECT account_id, min(ts) AS first_txn_ts, max(ts) AS last_txn_ts, datesub('day', min(ts), max(ts)) AS activity_span_days FROM txn_b GROUP BY 1", longs="activity_span_days")
    q["graph_degree"] = _sql(
        f"""SELECT account_id, od AS out_degree, oc AS out_txn_count, ov AS out_volume, id AS in_degree, ic AS in_txn_count, iv AS in_volume, {_r("id", "od", "1")} AS fan_in_out_ratio, {_r("iv - ov", "iv + ov")} AS volume_asymmetry, id + od AS total_degree FROM degrees""",
        "out_volume in_volume fan_in_out_ratio volume_asymmetry",
        "out_degree out_txn_count in_degree in_txn_count total_degree",
    )
    side = "SELECT {key} AS account_id, sum(amount) AS vol_{s}, count(*) AS txn_{s}, coalesce(sum(amount) FILTER (WHERE {flag} = 1), 0) AS vol_{s}_mule, count(*) FILTER (WHERE {flag} = 1) AS txn_{s}_mule FROM edges GROUP BY 1"
    q["graph_label_exposure"] = _sql(
        f"""SELECT *, {", ".join(f"{_r(f'{k}_{s}_mule', f'{k}_{s}', '1')} AS frac_{k}_{s}_mule" for k, s in _FRACS)}, {", ".join(f"{_r(f'({k}_sent_mule + {k}_recv_mule)', f'{k}_sent + {k}_recv', '1')} AS frac_{k}_mule_total" for k in ("vol", "txn"))} FROM (
      SELECT account_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in [*_SIDES, "n_mule_counterparties"])} FROM ({side.format(key="account_id", flag="cm", s="sent")}) a FULL JOIN ({side.format(key="counterparty_id", flag="am", s="recv")}) b USING (account_id) LEFT JOIN mule_nb USING (account_id))""",
        " ".join([*(c for c in _SIDES if c.startswith("vol")), *(f"frac_{k}_{s}_mule" for k, s in _FRACS), "frac_vol_mule_total frac_txn_mule_total"]),
        " ".join([*(c for c in _SIDES if c.startswith("txn")), "n_mule_counterparties"]),
    )
    q["ego_network_top10"] = _sql(
        f"""WITH e AS (SELECT account_id AS src, counterparty_id AS dst, sum(abs(amount)) AS weight FROM txn_a WHERE counterparty_id IS NOT NULL AND (account_id = '{CENTRE}' OR counterparty_id = '{CENTRE}') GROUP BY ALL),
      top AS (SELECT * FROM e ORDER BY weight DESC, src, dst LIMIT 10), nodes AS (SELECT src AS n FROM top UNION SELECT dst FROM top)
      SELECT src, dst, weight, CASE WHEN src = dst THEN 'hub' WHEN coalesce(s1, 0.95) > 0.8 THEN 'high' ELSE 'low' END AS tier FROM e LEFT JOIN scores s ON s.account_id = CASE WHEN src = '{CENTRE}' THEN dst ELSE src END
      WHERE src IN (SELECT n FROM nodes) AND dst IN (SELECT n FROM nodes)""",
        "weight",
    )
    q["yn_encode"] = _sql(f"SELECT {_ACCT.format('c_custkey')} AS account_id, c_acctbal > 5000 AS kyc_flag, c_mktsegment AS segment FROM customer", longs="kyc_flag")
    q["categorical_codes"] = _sql(f"SELECT {_ACCT.format('c_custkey')} AS account_id, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS segment FROM customer", longs="segment")
    q["feature_matrix"] = _matrix(
        q, V1 + V2, "pass_through_ratio * coalesce(in_degree, 0) AS pt_x_in_degree, rolling_7d_zscore_max * coalesce(total_txns, 0) AS zscore_x_txns", "pt_x_in_degree zscore_x_txns"
    )
    q["feature_matrix_v3"] = _matrix(q, V1 + V3)
    q["train_split"] = _sql(f"SELECT {_ACCT.format('c_custkey')} AS account_id, c_nationkey AS branch_code, CASE WHEN c_custkey % 5 < 2 THEN -1 ELSE CAST(c_acctbal < 0 AS INTEGER) END AS is_mule FROM customer", longs="branch_code is_mule")
    q["ghost_weights"] = _sql(
        f"SELECT account_id, CASE WHEN pass_through_ratio > 0.35 OR burst > 20 THEN 0.1 ELSE 1 END AS defensive, CASE WHEN pass_through_ratio > 0.18 OR burst > 20 THEN 0.7 ELSE 1 END AS robust FROM ({_pass(2).format('daily_b')}) LEFT JOIN bursts USING (account_id)",
        "defensive robust",
    )
    q["class_weight"] = _sql("SELECT CAST(count(*) FILTER (WHERE is_mule = 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE is_mule = 1), 0) AS scale_pos_weight FROM labels_", "scale_pos_weight")
    q["prob_blend"] = _sql("SELECT account_id, (s1 + s2) / 2 AS blend FROM scores", "blend")
    q["rank_blend"] = _sql("SELECT account_id, r1 AS rank_s1, r2 AS rank_s2, rank_blend FROM ranked", "rank_s1 rank_s2 rank_blend")
    q["auc_by_rank"] = _sql(f"SELECT {_auc('s1', _LABELLED)} AS auc", "auc")
    arms = [(f"mean {w:.2f}", f"(SELECT *, CAST({w} AS DOUBLE) * s1 + CAST({1 - w} AS DOUBLE) * s2 AS s FROM {_LABELLED})") for w in WEIGHTS]
    both = "(SELECT is_mule, (percent1 + percent2) / 2 AS s FROM (SELECT is_mule, (rank() OVER (ORDER BY s1) + (count(*) OVER (PARTITION BY s1) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER () AS percent1, (rank() OVER (ORDER BY s2) + (count(*) OVER (PARTITION BY s2) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER () AS percent2 FROM " + _LABELLED + "))"
    q["best_blend"] = _sql("SELECT strategy, auc FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS strategy, {i} AS k, {_auc('s', rows)} AS auc" for i, (n, rows) in enumerate([*arms, ("rank", both), ("geometric", f"(SELECT *, sqrt(s1 * s2) AS s FROM {_LABELLED})"), ("highest", f"(SELECT *, greatest(s1, s2) AS s FROM {_LABELLED})")])) + ") ORDER BY round(auc, 12) DESC, k LIMIT 1", "auc")
    q["f1_threshold_grid"] = _sql(
        f"""SELECT threshold, f1 FROM (SELECT i, i * (CAST(1 AS DOUBLE) / 1000) AS threshold, 2 * CAST(tp AS DOUBLE) / nullif(n + pos, 0) AS f1 FROM (SELECT i, count(*) FILTER (WHERE s1 > i * (CAST(1 AS DOUBLE) / 1000) AND is_mule = 1) AS tp,
      count(*) FILTER (WHERE s1 > i * (CAST(1 AS DOUBLE) / 1000)) AS n, sum(is_mule) AS pos FROM range(1001) g(i), {_LABELLED} GROUP BY i)) ORDER BY f1 DESC, i LIMIT 1""",
        "threshold f1",
    )
    q["prior_threshold"] = _sql("SELECT quantile_cont(s1, CAST(0.972085 AS DOUBLE)) AS threshold FROM scores", "threshold")
    q["flagged_accounts"] = _sql("SELECT account_id, s1 AS score FROM scores WHERE s1 >= (SELECT quantile_cont(s1, CAST(0.972085 AS DOUBLE)) FROM scores)", "score")
    q["pseudo_labels"] = _sql("SELECT account_id, rank_blend >= hi AS is_mule FROM ranked CROSS JOIN (SELECT quantile_cont(rank_blend, CAST(0.995 AS DOUBLE)) AS hi, quantile_cont(rank_blend, CAST(0.1 AS DOUBLE)) AS lo FROM ranked) WHERE rank_blend >= hi OR rank_blend <= lo", longs="is_mule")
    q["rank_displacement"] = _sql(
        """SELECT avg(d) AS mean_shift, max(d) AS max_shift, count(*) FILTER (WHERE d > 0.05) AS over_5pct, count(*) FILTER (WHERE d > 0.1) AS over_10pct, corr(r1, rb) AS spearman FROM (SELECT r1, rb, abs(r1 - rb) AS d FROM (
      SELECT r1, (rank() OVER (ORDER BY rank_blend) + (count(*) OVER (PARTITION BY rank_blend) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER () AS rb FROM ranked))""",
        "mean_shift max_shift spearman",
        "over_5pct over_10pct",
    )
    q["lifecycle_window"] = _sql("SELECT * FROM life")
    q["peak_window"] = _sql("SELECT * FROM peak_w")
    q["window_size_stats"] = _sql(
        "SELECT avg(d) AS mean_days, CAST(median(d) AS DOUBLE) AS median_days, min(d) AS min_days, max(d) AS max_days, count(*) FILTER (WHERE d < 7) AS under_7, count(*) FILTER (WHERE d < 30) AS under_30, count(*) FILTER (WHERE d < 90) AS under_90 FROM (SELECT suspicious_end - suspicious_start AS d FROM peak_w)",
        "mean_days median_days",
        "min_days max_days under_7 under_30 under_90",
    )
    q["submission"] = _sql("SELECT account_id, s1 AS is_mule, coalesce(strftime(suspicious_start, '%Y-%m-%d %H:%M:%S'), '') AS suspicious_start, coalesce(strftime(suspicious_end, '%Y-%m-%d %H:%M:%S'), '') AS suspicious_end FROM scores LEFT JOIN life USING (account_id)", "is_mule")
    q["value_counts"] = _sql("SELECT channel, count(*) AS count FROM txn_a GROUP BY 1")
    columns = ["transaction_id", "account_id", "counterparty_id", "amount", "txn_type", "channel", "mcc_code", "ts", "scaled_amount"]
    added = {"balance": "balance_after_transaction", "ip": "ip_address", "lat": "latitude", "lon": "longitude", "sub_type": "transaction_sub_type", "part_type": "part_transaction_type"}
    nulls = [f"count(*) FILTER (WHERE {c} IS NULL) AS {to}" for c, to in [*((c, c) for c in columns), *added.items()]]
    q["null_counts"] = _sql(f"SELECT {', '.join(nulls)} FROM txn_b JOIN add_b USING (transaction_id)")
    q["safety_gate"] = _sql(f"SELECT auc, coalesce(auc > {GATE}, false) AS passes FROM (SELECT {_auc('s1', _LABELLED)} AS auc)", "auc", "passes")
    q["row_count_check"] = _sql("SELECT (SELECT count(*) FROM scores) AS n, (SELECT count(*) FROM accts) AS expected, 1 AS same", longs="n expected same")
    q["sampled_accounts"] = _sql("SELECT account_id FROM accts ORDER BY md5(account_id || ' 42'), account_id LIMIT 100")
    q["first_transactions"] = _sql("SELECT transaction_id, amount FROM txn_b ORDER BY transaction_id LIMIT 50", "amount", "transaction_id")
    q["parquet_round_trip"] = _sql("SELECT transaction_id, account_id, amount FROM txn_b", "amount", "transaction_id")
    q["csv_round_trip"] = _sql(q["submission"].body, "is_mule")
    q["limited_scan"] = _sql("SELECT least(25, count(*)) AS n, least(25, count(*)) AS events FROM events", longs="n events")
    q["stored_artefacts"] = _sql(
        f"""SELECT 'scores' AS artefact, count(*) AS rows, 0 AS value FROM scores UNION ALL SELECT 'importances', 1, 0 UNION ALL SELECT 'parameters', 2, 0
      UNION ALL SELECT 'threshold', 1, threshold FROM ({q["prior_threshold"].body})""",
        "value",
        "rows",
    )
    q["clean_numbers"] = _sql(
        "SELECT account_id, CASE WHEN s1 > 0.3 THEN 0 ELSE s1 END AS zeroed, CASE WHEN s1 > 0.7 THEN 99.5 WHEN s1 > 0.5 THEN -99.5 WHEN s1 > 0.3 THEN 0 ELSE s1 END AS bounded FROM scores", "zeroed bounded"
    )
    q["log_volume"] = _sql("SELECT account_id, ln(1 + total_volume) AS log_volume, ln(1 + CAST(total_txns AS DOUBLE)) AS log_txns FROM basic_a", "log_volume log_txns")
    half = "(SELECT *, day(ts) % 2 AS b FROM txn_b JOIN add_b USING (transaction_id))"
    q["txn_balance_batched"] = _sql(
        f"""SELECT account_id, avg(s) AS balance_std, avg(a) AS balance_mean, min(lo) AS balance_min, max(hi) AS balance_max, sum(z) AS near_zero_balance_count, sum(m) AS negative_balance_count FROM (
      SELECT account_id, b, stddev_samp(balance) AS s, avg(balance) AS a, min(balance) AS lo, max(balance) AS hi, count(*) FILTER (WHERE abs(balance) < 100) AS z, count(*) FILTER (WHERE balance < 0) AS m
      FROM {half} WHERE balance IS NOT NULL GROUP BY ALL) GROUP BY 1""",
        "balance_std balance_mean balance_min balance_max",
        "near_zero_balance_count negative_balance_count",
    )
    q["txn_ip_batched"] = _sql(f"SELECT account_id, sum(u) AS n_unique_ips, sum(n) AS n_ip_txns FROM (SELECT account_id, b, count(DISTINCT ip) AS u, count(*) AS n FROM {half} WHERE ip IS NOT NULL GROUP BY ALL) GROUP BY 1", longs="n_unique_ips n_ip_txns")
    return q
