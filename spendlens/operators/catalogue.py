"""Reward-card catalogue (R1) and the card combinations searched by R5.

The catalogue is a fixed dimension of a few cards; everything derived here
(combinations, per-combination best rates) depends on the catalogue only, not
on the data, so it is prepared once on the driver and enters the plans as
literals or as tiny broadcast tables.  Rates are exact decimals.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

EATING = "Eating Places and Restaurants"
BOOKS = "Book Stores"
AMUSEMENT = "Amusement Parks, Carnivals, Circuses"
GROCERY = "Grocery Stores, Supermarkets"
SERVICE = "Service Stations"
TRAVEL = "Travel"

D = Decimal


@dataclass(frozen=True)
class Card:
    name: str
    annual_fee: int
    rates: tuple[tuple[str, Decimal], ...]  # listed categories, in catalogue order
    default_rate: Decimal
    signup_bonus: int
    spending_requirement: int | None = None
    extras: tuple[tuple[str, object], ...] = field(default=())

    def rate(self, category: str) -> Decimal:
        return dict(self.rates).get(category, self.default_rate)

    def all_rates(self) -> list[Decimal]:
        return [r for _, r in self.rates] + [self.default_rate]


# The reward-card catalogue, in its listing order.
CATALOGUE: tuple[Card, ...] = (
    Card("Chase Freedom Unlimited", 0, ((EATING, D("0.03")), (BOOKS, D("0.03"))), D("0.015"),
         200, 500),
    Card("Chase Sapphire Preferred", 95, ((AMUSEMENT, D("0.02")), (EATING, D("0.02"))),
         D("0.01"), 600, 4000, (("transfer_partners", True),)),
    Card("American Express Gold", 250, ((EATING, D("0.04")), (GROCERY, D("0.04"))), D("0.01"),
         600, 4000, (("credits", 120),)),
    Card("Citi Double Cash", 0, (), D("0.02"), 200, 1500),
    Card("Capital One Savor", 95, ((EATING, D("0.04")), (AMUSEMENT, D("0.04")),
                                   (GROCERY, D("0.02"))), D("0.01"), 300, 3000),
    Card("Discover it Cash Back", 0, ((SERVICE, D("0.05")), (EATING, D("0.05"))), D("0.01"), 0,
         None, (("cashback_match", True),)),
)

# Fixed values: "best for" text of each catalogue card in the comparison table.
BEST_FOR = {
    "Chase Freedom Unlimited": "General spending + Restaurants",
    "Chase Sapphire Preferred": "Travel + Dining",
    "American Express Gold": "Heavy restaurant/grocery spending",
    "Citi Double Cash": "Everything (2% flat rate)",
    "Capital One Savor": "Dining + Entertainment",
    "Discover it Cash Back": "Rotating categories + First year",
}

# Rules for the rewards of the client's current cards, applied per
# card in this order (first matching rule wins); base rate 1 %.
CURRENT_BASE_RATE = D("0.01")
CURRENT_BRAND_RULES = (
    ("chase", (EATING, AMUSEMENT), D("0.02")),
    ("amex", (EATING, GROCERY), D("0.03")),
    ("discover", (SERVICE,), D("0.05")),
)

# Flat reward rates by card brand of the owned-cards analysis.
BRAND_RATES = {
    "Visa": ({EATING: D("0.02"), SERVICE: D("0.02"), GROCERY: D("0.015")}, D("0.01")),
    "Mastercard": ({EATING: D("0.03"), TRAVEL: D("0.02"), AMUSEMENT: D("0.02")}, D("0.01")),
    "American Express": ({TRAVEL: D("0.03"), AMUSEMENT: D("0.02"), GROCERY: D("0.015")},
                         D("0.01")),
    "Discover": ({SERVICE: D("0.05"), EATING: D("0.02"), BOOKS: D("0.02")}, D("0.01")),
}

OTHER_KEY = "__other__"


def rate_keys(catalogue: tuple[Card, ...] = CATALOGUE) -> list[str]:
    """Categories with a rate of their own somewhere (catalogue or current-card
    rules); every other category pays the default rates."""
    keys: list[str] = []
    for c in catalogue:
        for k, _ in c.rates:
            if k not in keys:
                keys.append(k)
    for _, cats, _ in CURRENT_BRAND_RULES:
        for k in cats:
            if k not in keys:
                keys.append(k)
    return keys


@dataclass(frozen=True)
class Portfolio:
    pid: int           # enumeration ordinal: sizes 1..max, combinations in catalogue order
    members: tuple[int, ...]

    def cards(self, catalogue=CATALOGUE) -> list[Card]:
        return [catalogue[i] for i in self.members]

    def fees(self, catalogue=CATALOGUE) -> int:
        return sum(c.annual_fee for c in self.cards(catalogue))

    def bonuses(self, catalogue=CATALOGUE) -> int:
        return sum(c.signup_bonus for c in self.cards(catalogue))

    def best(self, category: str | None, floor: Decimal = D(0),
             floor_card: str | None = None, catalogue=CATALOGUE) -> tuple[Decimal, str | None]:
        """Best rate of the members for a category (``None`` = an unlisted
        one): strict ``>`` scan in member order starting from ``floor``."""
        rate, card = floor, floor_card
        for c in self.cards(catalogue):
            r = c.default_rate if category is None else c.rate(category)
            if r > rate:
                rate, card = r, c.name
        return rate, card


def portfolios(max_cards: int = 3, catalogue: tuple[Card, ...] = CATALOGUE) -> list[Portfolio]:
    out: list[Portfolio] = []
    for k in range(1, max_cards + 1):
        for combo in combinations(range(len(catalogue)), k):
            out.append(Portfolio(len(out), combo))
    return out


def undominated(ports: list[Portfolio], keys: list[str],
                catalogue: tuple[Card, ...] = CATALOGUE) -> list[Portfolio]:
    """Without portfolios that can never win: spending is never negative, so
    one whose fee is no lower than an earlier one's and whose best rate is no
    higher for any rate key loses or ties, and ties go to the earlier one."""
    kept: list[Portfolio] = []
    vectors = np.empty((0, len(keys) + 2), np.int64)
    for p in ports:
        v = np.array([int(p.best(k, catalogue=catalogue)[0] * 10000) for k in [*keys, None]]
                     + [-p.fees(catalogue)])
        if not (vectors >= v).all(1).any():
            kept.append(p)
            vectors = np.vstack([vectors, v])
    return kept


def catalogue_frames(spark: SparkSession, catalogue: tuple[Card, ...] = CATALOGUE
                     ) -> tuple[DataFrame, DataFrame]:
    """R1 as two small DataFrames: cards (one row per card) and card_rates
    (one row per listed category in listing order, plus a ``default`` row per
    card)."""
    cards = spark.createDataFrame(
        [(i, c.name, c.annual_fee, c.signup_bonus, c.spending_requirement, c.default_rate,
          BEST_FOR.get(c.name)) for i, c in enumerate(catalogue)],
        T.StructType([
            T.StructField("card_ordinal", T.IntegerType()), T.StructField("card", T.StringType()),
            T.StructField("annual_fee", T.IntegerType()),
            T.StructField("signup_bonus", T.IntegerType()),
            T.StructField("spending_requirement", T.IntegerType()),
            T.StructField("default_rate", T.DecimalType(6, 4)),
            T.StructField("best_for", T.StringType())]))
    rates = spark.createDataFrame(
        [(c.name, k, r, i) for c in catalogue
         for i, (k, r) in enumerate((*c.rates, ("default", c.default_rate)))],
        T.StructType([T.StructField("card", T.StringType()),
                      T.StructField("category", T.StringType()),
                      T.StructField("rate", T.DecimalType(6, 4)),
                      T.StructField("position", T.IntegerType())]))
    return cards, rates


def break_even(card: Card) -> float | None:
    """Fee / mean of all the card's rates (default included)."""
    if card.annual_fee <= 0:
        return None
    rates = card.all_rates()
    avg = sum(rates) / len(rates)
    return float(round(D(card.annual_fee) / avg, 2)) if avg > 0 else 0.0


def highlights(card: Card) -> tuple[str, str]:
    """The first listed category paying more than 2 % (or the general
    rate), and up to three categories paying 3 % or more."""
    best = [f"{k} ({float(r) * 100:.0f}%)" for k, r in card.rates if r > D("0.02")]
    best_for = best[0] if best else f"General rewards: {float(card.default_rate) * 100:.1f}%"
    high = [f"{k}: {float(r) * 100:.0f}% rewards" for k, r in card.rates if r >= D("0.03")][:3]
    return best_for, "; ".join(high)


def catalogue_from_frames(cards: DataFrame, rates: DataFrame) -> tuple[Card, ...]:
    """A user-supplied catalogue (same shape as :func:`catalogue_frames`) as
    ``Card`` objects.  The catalogue is configuration, not data: the cards on
    offer and their rates, read whole and once."""
    card_rows = cards.orderBy("card_ordinal").collect()
    listed: dict[str, list[tuple[str, Decimal]]] = {r["card"]: [] for r in card_rows}
    for r in rates.orderBy("card", "position").collect():
        if r["category"] != "default" and r["card"] in listed:
            listed[r["card"]].append((r["category"], Decimal(r["rate"])))
    return tuple(
        Card(r["card"], int(r["annual_fee"]), tuple(listed[r["card"]]),
             Decimal(r["default_rate"]), int(r["signup_bonus"]), r["spending_requirement"])
        for r in card_rows)
