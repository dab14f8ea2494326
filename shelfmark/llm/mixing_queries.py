"""Queries on mixing sources."""

from shelfmark.llm.mixing import mix, reached
from shelfmark.session import table


def p7_mix(spark, sf_dir):
    """The documents of the training set, each with how often it is used."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark, sf_dir):
    """Shares wanted and really reached."""
    return reached(*mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")))


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
ORACLE = {}
