"""Composite queries: the voter audit and the threat log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.joins import left_join
from ..operators.query import JoinQuery
from ..operators.setops import at_least_k


def registered(licences: DataFrame, voters: DataFrame) -> DataFrame:
    """A state's licence holders (dl, na, ssn, ad) and whether they are registered voters (dl)."""
    return left_join(licences, voters, "dl", "dl", ["dl", "na", "ssn", "ad"], flag="registered")


def voter_audit(state1: DataFrame, state2: DataFrame) -> DataFrame:
    """People (by ssn) with a licence in both states of registered(): what each state learns.

    A name is revealed to a state where the person is registered in both, or registered
    there with the older address; else it reads 0. s tells whether the ssn matched.
    """
    q = JoinQuery()
    ssn = q.join_on(state1, "ssn", state2, "ssn")
    ad1, ad2 = q.input("left", "ad"), q.input("right", "ad")
    reg1, reg2 = q.input("left", "registered"), q.input("right", "registered")
    na1, na2 = q.input("left", "na"), q.input("right", "na")
    older1, double = ad1 < ad2, reg1 & reg2
    q.output("ssn", ssn)
    q.output("na1", na1 * (double | (older1 & reg1)))
    q.output("na2", na2 * (double | (~older1 & reg2)))
    q.output("ad1", ad1)
    q.output("ad2", ad2)
    q.no_reveal("s")
    return q.run()


def threat_log(logs: Sequence[DataFrame], key: str, k: int) -> DataFrame:
    """Keys that k of the logs or more hold, and in how many."""
    return at_least_k(logs, key, k)
