"""Payouts, stakes and their expectations as column expressions; prices are decimal, payouts per 10 units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def implied(price: Column) -> Column:
    return F.when(price > 0, 1 / price)


def expected_value(p: Column, price: Column) -> Column:
    return p * price - 1


def clears(p: Column, price: Column, threshold: Column | float) -> Column:
    """Whether a bet at a valid price has an expected value of the threshold at least; never null."""
    return F.coalesce((p > 0) & (price > 1) & (expected_value(p, price) >= threshold), F.lit(False))


def round_stake(amount: Column, unit: float = 10.0, least: float = 10.0) -> Column:
    """The nearest multiple of ``unit``; nothing below ``least``."""
    stake = F.floor(amount / unit + 0.5) * unit
    return F.when((amount >= least) & (stake >= least), stake.cast("double")).otherwise(0.0)


def kelly(p: Column, price: Column) -> Column:
    """The fraction of a bank that maximises the mean log of wealth for one bet, 0 without an edge."""
    edge = p * price - 1
    return F.when((price > 1) & (p > 0) & (edge > 0), F.least(edge / (price - 1), F.lit(1.0))).otherwise(0.0)


def exacta_free(p: Column, q: Column) -> Column:
    """Chance that two runners fill the first two places in any order, places drawn in turn by win chance."""
    return p * q * (1 / F.greatest(1 - p, F.lit(1e-12)) + 1 / F.greatest(1 - q, F.lit(1e-12)))


def net_pool(gross: Column, takeout: float) -> Column:
    return gross * (1 - takeout)


def win_dividend(gross: Column, on_winner: Column, takeout: float, winners: Column | int = 1, unit: float = 10.0) -> Column:
    """Payout per unit; the net pool is shared among winners that tie. 0 where nobody backed the winner."""
    n = F.lit(winners) if isinstance(winners, int) else winners
    return F.when((on_winner > 0) & (n >= 1), unit * net_pool(gross, takeout) / n / on_winner).otherwise(0.0)


def place_dividend(gross: Column, on_runner: Column, places: Column, takeout: float, unit: float = 10.0) -> Column:
    """Payout per unit where the net pool is shared by the paid places; the stake at least."""
    return F.when((on_runner > 0) & (places >= 1), F.greatest(F.lit(unit), unit * net_pool(gross, takeout) / places / on_runner)).otherwise(0.0)


def impact_dividend(gross: Column, on_winner: Column, stake: Column, takeout: float, unit: float = 10.0) -> Column:
    """Payout per unit once one's own stake is in the pool."""
    return win_dividend(gross + stake, on_winner + stake, takeout, 1, unit)


def win_profit(stake: Column, won: Column, payout: Column, price: Column) -> Column:
    """Settled by the payout where there is one, else at the price; a lost bet loses its stake."""
    back = F.when(payout > 0, stake * payout / 10).when(price > 0, stake * price).otherwise(stake)
    return F.when(won > 0, back - stake).otherwise(-stake)


def place_profit(stake: Column, placed: Column, payout: Column) -> Column:
    """A placed runner without a payout returns its stake."""
    return F.when(placed > 0, F.when(payout > 0, stake * payout / 10 - stake).otherwise(0.0)).otherwise(-stake)


def rebate(losing: Column, rate: float, threshold: float) -> Column:
    return F.when(losing > threshold, rate * (losing - threshold)).otherwise(0.0)
