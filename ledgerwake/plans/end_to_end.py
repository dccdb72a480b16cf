"""From tables to a submission: features, out-of-fold training, scoring, threshold, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import decisions as D
from ..operators import series as S
from ..operators import static as M
from ..operators import target_encoding as E
from ..sources import write_parquet
from ..staging import written, written_all


#: Keys of out-of-fold encodings, by tag: with statistics of risk, and of any keys.
ENCODED = {"counterparty": ["counterparty_id"], "mcc": ["mcc_code"], "channel": ["channel"], "pair": ["counterparty_id", "channel"]}
FAMILIES = {"txntype": ["txn_type"], "mcc_txn": ["mcc_code", "txn_type"], "cp_txn": ["counterparty_id", "txn_type"]}


def feature_tables(
    txns: DataFrame, accounts: DataFrame, labels: DataFrame, joined: DataFrame | None = None, scores: DataFrame | None = None,
    recent: tuple[str, str] | None = None, opened: DataFrame | None = None,
) -> list[DataFrame]:
    """The feature tables of the matrix. joined are the transactions with their additional columns, scores (account_id, score) what there is
    of neighbours' risk, recent the first days of the last three and six months, opened the accounts with their opening date.

    Transactions and the daily grain are written once, so that what they are made from is not read by each feature; so is each table.
    """
    txns = written(txns, "transactions")
    days, folds = written(S.daily(txns), "daily"), E.folds(labels)
    basic = A.txn_basic(txns)
    out = [
        basic, A.temporal_patterns(txns), S.gaps(txns), A.graph_degree(txns), A.graph_labels(txns, labels), S.monthly(txns),
        S.passthrough_hours(txns), S.concentration(txns), S.rolling_zscore(days),
    ]
    out += [S.cp_entropy(txns), S.peak_day(days), S.pass_through(days), A.cp_frequency(txns, accounts)]
    out += [E.account_stats(E.encoded(txns, folds, keys, E.ALPHA[t]), accounts, folds, t) for t, keys in ENCODED.items()]
    out += [E.family(txns, accounts, folds, keys, E.ALPHA[t], t) for t, keys in FAMILIES.items()]
    if scores is not None:
        out.append(A.neighbor_risk(txns, scores))
    if recent is not None:
        out.append(A.recency(txns, accounts, *recent))
    if opened is not None:
        out.append(S.days_to_first(txns, opened))
    if joined is not None:
        joined = written(joined, "transactions-additional")
        out += [
            A.additional_features(joined), S.turnover(basic, A.balances(joined)), A.mule_ips(joined, labels, accounts),
            A.sub_types(joined, accounts),
        ]
    return written_all({f"features-{i}": x for i, x in enumerate(out)})


def train_and_score(
    matrix: DataFrame, labels: DataFrame, test_accounts: DataFrame, folds: int = 5, trees: int = 20, depth: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold scores of labelled accounts, scores of test accounts as the mean of the folds' models)."""
    columns = M.numeric_columns(matrix)
    matrix = written(matrix, "matrix")
    train, test = M.split(matrix, E.folds(labels, folds), test_accounts)
    oof, models = D.out_of_fold(train.withColumn("weight", D.ghost_weight()), columns, folds, trees, depth)
    return oof, D.scored_new(models, test, columns)


def retrained(matrix: DataFrame, labels: DataFrame, test_accounts: DataFrame, folds: int = 5, trees: int = 20, depth: int = 4) -> DataFrame:
    """Out-of-fold scores of labelled accounts after test accounts at both ends of the first run's scores have joined the training, with
    their pseudo-labels and in no fold that is scored."""
    columns = M.numeric_columns(matrix)
    matrix = written(matrix, "matrix")
    train, test = M.split(matrix, E.folds(labels, folds), test_accounts)
    weighted = train.withColumn("weight", D.ghost_weight())
    _, models = D.out_of_fold(weighted, columns, folds, trees, depth)
    pseudo = D.pseudo_labels(written(D.scored_new(models, test, columns), "test-scores"))
    new = test.withColumn("weight", D.ghost_weight()).withColumn("fold", F.lit(-1))
    return D.out_of_fold(M.augmented(weighted, new, pseudo), columns, folds, trees, depth)[0]


def artefacts(scores: DataFrame, importances: DataFrame, path: str, parameters: dict[str, str]) -> None:
    """Writes what a run leaves: scores, importances, threshold and parameters, as Parquet tables under path."""
    write_parquet(scores, f"{path}/scores")
    write_parquet(importances, f"{path}/importances")
    write_parquet(D.prior_threshold(scores), f"{path}/threshold")
    write_parquet(scores.sparkSession.createDataFrame(sorted(parameters.items()), "name string, value string"), f"{path}/parameters")


def submission(txns: DataFrame, scores: DataFrame, peak: bool = False, prior: float = D.PRIOR) -> DataFrame:
    """Scores with the windows of the accounts that the prior flags: their lifetime, or the days around their peak."""
    flagged = D.flagged(scores, prior)
    own = txns.join(flagged.select("account_id"), "account_id", "left_semi")
    windows = S.peak_window(S.daily(own)) if peak else S.lifecycle(txns, flagged)
    return D.submission(scores, windows)
