"""Synthetic e-commerce rows with weighted categories, generated on executors.

A row's choices are digits of md5(key:seed:name): a counter-based generator, so
rows need no order, no driver loop and no state, any engine that knows md5 makes
the same ones, and the work scales with the input table. A uniform choice takes
the digits modulo the number of options, a weighted one maps them as a number
in [0, 1) through the cumulative weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Category weights of the generated order and payment rows.
ORDER_STATUS = [("completed", 70), ("pending", 15), ("cancelled", 10), ("refunded", 5)]
CHANNELS = [("web", 1), ("mobile", 1), ("pos", 1), ("api", 1)]
PAY_METHOD = [("credit_card", 40), ("debit_card", 20), ("pix", 20), ("boleto", 10), ("wallet", 10)]
PAY_STATUS = [("authorized", 10), ("captured", 30), ("settled", 40), ("declined", 15), ("refunded", 5)]
SEGMENTS = [("consumer", 1), ("business", 1), ("enterprise", 1), ("vip", 1)]
CATEGORIES = ["electronics", "clothing", "food", "books", "home", "sports"]

# Words that names are put together from.
FIRST_NAMES = ["Ada", "Bruno", "Carla", "Davi", "Elena", "Felix", "Gita", "Hugo", "Ines", "Jonas", "Kaya", "Leon"]
LAST_NAMES = ["Almeida", "Berger", "Costa", "Duarte", "Evans", "Fischer", "Garcia", "Hansen", "Ito", "Jansen"]
CITIES = [("Curitiba", "PR"), ("Recife", "PE"), ("Manaus", "AM"), ("Santos", "SP"), ("Niteroi", "RJ"), ("Olinda", "PE"), ("Londrina", "PR")]
ADJECTIVES = ["Compact", "Durable", "Elegant", "Folding", "Quiet", "Robust", "Smart"]
NOUNS = ["Lamp", "Backpack", "Kettle", "Notebook", "Speaker", "Jacket", "Racket", "Blender"]
BRANDS = ["Norte", "Palma", "Quasar", "Ribeira", "Solano", "Tucano"]
DOMAINS = ["example.com", "example.org", "example.net"]

#: days are counted from here
EPOCH = "2023-01-01"
_DIGITS = 13  #: hexadecimal digits of a draw: 52 bits, exact as a double


def draw(key: Column, seed: int, salt: str) -> Column:
    """A whole number of 52 bits from (key, seed, salt)."""
    text = F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long")


def uniform(key: Column, seed: int, salt: str) -> Column:
    """Deterministic uniform in [0, 1) from (key, seed, salt)."""
    return draw(key, seed, salt).cast("double") / float(1 << (4 * _DIGITS))


def weighted_choice(u: Column, weights: list[tuple[str, int]]) -> Column:
    total = float(sum(w for _, w in weights))
    acc = 0.0
    expr = None
    for value, w in weights[:-1]:
        acc += w / total
        expr = F.when(u < acc, F.lit(value)) if expr is None else expr.when(u < acc, F.lit(value))
    last = F.lit(weights[-1][0])
    return last if expr is None else expr.otherwise(last)


def one_of(options: list[str], n: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), (n % len(options)).cast("int"))


def day(n: Column, days: int) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), (n % days).cast("int"))


def generate_customers(keys: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """One customer per input key: id, name, email, city, state, segment, created_at (within two years)."""
    k = F.col(key)
    first, last = one_of(FIRST_NAMES, draw(k, seed, "first")), one_of(LAST_NAMES, draw(k, seed, "last"))
    place = draw(k, seed, "city")
    return keys.select(
        k.alias("id"),
        F.concat_ws(" ", first, last).alias("name"),
        F.concat(F.lower(first), F.lit("."), F.lower(last), k.cast("string"), F.lit("@"), one_of(DOMAINS, draw(k, seed, "domain"))).alias("email"),
        one_of([c for c, _ in CITIES], place).alias("city"),
        one_of([s for _, s in CITIES], place).alias("state"),
        one_of([s for s, _ in SEGMENTS], draw(k, seed, "segment")).alias("segment"),
        day(draw(k, seed, "created"), 730).alias("created_at"),
    )


def generate_products(keys: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """One product per input key: id, name, category, price (5 to 500), brand, stock (0 to 500)."""
    k = F.col(key)
    return keys.select(
        k.alias("id"),
        F.concat_ws(" ", one_of(ADJECTIVES, draw(k, seed, "adjective")), one_of(NOUNS, draw(k, seed, "noun"))).alias("name"),
        one_of(CATEGORIES, draw(k, seed, "category")).alias("category"),
        ((F.lit(500) + draw(k, seed, "price") % 49_501).cast("double") / 100).alias("price"),
        one_of(BRANDS, draw(k, seed, "brand")).alias("brand"),
        (draw(k, seed, "stock") % 501).cast("int").alias("stock"),
    )


def _numbered(rows: DataFrame, column: str, *carry: str) -> DataFrame:
    """Rows with _i = 1..n in the order of ``column``: range partitions and their offsets, no single task."""
    from strata.operators.ledger import sequence_numbers

    return sequence_numbers(rows.select(column, *carry), [F.col(column)]).select(column, *carry, F.col("seq").alias("_i"))


def generate_orders(keys: DataFrame, key: str, customers: DataFrame, products: DataFrame, seed: int = 42) -> DataFrame:
    """One generated order per input key.

    customer and product are picked uniformly among the given customer and
    product tables (joined on their place by id, not collected); qty 1..5,
    total = price * qty (2 decimals), weighted status, uniform channel, a day
    within one year.
    """
    k = F.col(key)
    cust = _numbered(customers.select(F.col("id").alias("customer_id")), "customer_id").withColumnRenamed("_i", "_ci")
    prod = _numbered(products.select(F.col("id").alias("product_id"), "price"), "product_id", "price").withColumnRenamed("_i", "_pi")
    # Table sizes as scalar subqueries (computed once, no join).
    n_c = customers.select(F.count(F.lit(1))).scalar()
    n_p = products.select(F.count(F.lit(1))).scalar()
    base = keys.select(k.alias("id"), n_c.alias("_nc"), n_p.alias("_np"))
    i = F.col("id")
    picked = base.select(
        "id",
        (draw(i, seed, "customer") % F.col("_nc") + 1).alias("_ci"),
        (draw(i, seed, "product") % F.col("_np") + 1).alias("_pi"),
        (draw(i, seed, "qty") % 5 + 1).cast("int").alias("qty"),
        weighted_choice(uniform(i, seed, "status"), ORDER_STATUS).alias("status"),
        one_of([c for c, _ in CHANNELS], draw(i, seed, "channel")).alias("channel"),
        day(draw(i, seed, "ordered"), 365).alias("created_at"),
    )
    return (
        picked.join(cust, "_ci")
        .join(prod, "_pi")
        .select("id", "customer_id", "product_id", "qty",
                F.round(F.col("price") * F.col("qty"), 2).alias("total"), "status", "channel", "created_at")
    )


def generate_transactions(orders: DataFrame, seed: int = 42, keys: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Payments: id, order_id, amount (the order's total), weighted method and status, a day within one year.

    With ``keys``, one payment per key for an order picked uniformly; without
    them, one payment per order, whose id is the order's.
    """
    if keys is None:
        paid = orders.select(F.col("id"), F.col("id").alias("order_id"), F.col("total").alias("amount"))
    else:
        numbered = _numbered(orders.select(F.col("id").alias("order_id"), F.col("total").alias("amount")), "order_id", "amount")
        n = orders.select(F.count(F.lit(1))).scalar()
        k = F.col(key)
        paid = keys.select(k.alias("id"), n.alias("_n")).select("id", (draw(F.col("id"), seed, "order") % F.col("_n") + 1).alias("_i")).join(numbered, "_i")
    i = F.col("id")
    return paid.select(
        "id",
        "order_id",
        "amount",
        weighted_choice(uniform(i, seed, "method"), PAY_METHOD).alias("method"),
        weighted_choice(uniform(i, seed, "pay_status"), PAY_STATUS).alias("status"),
        day(draw(i, seed, "paid"), 365).alias("created_at"),
    )
