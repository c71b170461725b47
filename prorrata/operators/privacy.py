"""Personal data at rest: encrypted columns, and index columns to match on.

The key and the secret of the index never are literals of a plan: they are read
by scalar subqueries from a table of one row in memory, so that neither
explain() nor an event log shows them.

Encryption is randomised, so equal values have different ciphertexts. What has
to be matched (document, account) also gets an index: a keyed hash of the
value. Joins and upserts use the index; ciphertext is only opened in the last
projection of a result that shows it.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prorrata.operators.allocation import BLOCK_ROWS, Allocation, allocate_payments
from prorrata.operators.imports import (
    Import, accounts_with_open_link, append_payments, import_links, stage_payments, stage_persons,
)
from prorrata.operators.reports import CONTACT, top_debtors
from prorrata.operators.upsert import upsert
from prorrata.schemas import PERSON, PERSONAL_COLUMNS

DOCUMENT_INDEX, ACCOUNT_INDEX, PAYMENT_INDEX = "dni_bidx", "cbu_bidx", "cuenta_bidx"
CONTACT_INDEX = "contacto_bidx"


@dataclass(frozen=True)
class Keys:
    """AES-256 key and the secret of the index; neither is ever printed."""

    key: bytes = field(repr=False)
    pepper: str = field(repr=False)
    _tables: dict = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self) -> None:
        if len(self.key) != 32:
            raise ValueError("the encryption key must have 32 bytes")

    def columns(self) -> tuple[Column, Column]:
        """Key and pepper as columns of the active session."""
        spark = SparkSession.active()
        if self._tables.get("session") is not spark:
            row = spark.createDataFrame([(bytearray(self.key), self.pepper + "\n")], "secret_key binary, secret_pepper string")
            self._tables.update(session=spark, secrets=row)
        secrets = self._tables["secrets"]
        return secrets.select("secret_key").scalar(), secrets.select("secret_pepper").scalar()

    @classmethod
    def from_conf(cls, spark: SparkSession) -> Keys:
        key = spark.conf.get("spark.prorrata.privacy.key", None)
        pepper = spark.conf.get("spark.prorrata.privacy.pepper", None)
        if not key or not pepper:
            raise ValueError("set spark.prorrata.privacy.key (64 hex digits) and spark.prorrata.privacy.pepper")
        return cls(bytes.fromhex(key), pepper)


def blind_index(value: Column, keys: Keys) -> Column:
    """Keyed hash in two layers, so that no index can be continued to that of a longer value."""
    _, pepper = keys.columns()
    return F.sha2(F.concat(pepper, F.sha2(F.concat(pepper, value), 256)), 256)


def encrypted(value: Column, keys: Keys) -> Column:
    return F.aes_encrypt(value, keys.columns()[0])


def decrypted(value: Column, keys: Keys) -> Column:
    return F.aes_decrypt(value, keys.columns()[0]).cast("string")


def encrypt_persons(persons: DataFrame, keys: Keys) -> DataFrame:
    personal = {c: encrypted(F.col(c), keys) for c in PERSONAL_COLUMNS}
    return persons.withColumns(
        {
            DOCUMENT_INDEX: blind_index(F.col("DNI"), keys),
            ACCOUNT_INDEX: blind_index(F.col("Cbu_Cvu"), keys),
        }
    ).withColumns(personal)


def with_contact_index(persons: DataFrame, keys: Keys) -> DataFrame:
    """Persons in the clear with the index of what the debtor report shows of them; people who share it are one."""
    return persons.withColumn(CONTACT_INDEX, blind_index(F.to_json(F.struct(*CONTACT)), keys))


def decrypt_persons(persons: DataFrame, keys: Keys) -> DataFrame:
    return persons.withColumns({c: decrypted(F.col(c), keys) for c in PERSONAL_COLUMNS})


def encrypt_payments(payments: DataFrame, keys: Keys) -> DataFrame:
    index = blind_index(F.col("Cuenta_Origen"), keys)
    return payments.withColumn(PAYMENT_INDEX, index).withColumn(
        "Cuenta_Origen", encrypted(F.col("Cuenta_Origen"), keys)
    )


def decrypt_payments(payments: DataFrame, keys: Keys) -> DataFrame:
    return payments.withColumn("Cuenta_Origen", decrypted(F.col("Cuenta_Origen"), keys))


def import_encrypted_persons(raw: DataFrame, target: DataFrame, keys: Keys, ordinal: str = "ordinal") -> Import:
    """Persons are matched by the index of their document, so a second run updates instead of duplicating."""
    persons, rejects = stage_persons(raw, ordinal)
    table = upsert(target, encrypt_persons(persons, keys), [DOCUMENT_INDEX], PERSON.name, id_column="Id_Persona")
    return Import(table, rejects)


def import_encrypted_links(
    raw: DataFrame,
    condominiums: DataFrame,
    units: DataFrame,
    persons: DataFrame,
    target: DataFrame,
    as_of: dt.date,
    keys: Keys,
) -> Import:
    account = blind_index(F.trim("cbu"), keys)
    return import_links(raw, condominiums, units, persons, target, as_of, account, ACCOUNT_INDEX)


def import_encrypted_payments(
    raw: DataFrame, persons: DataFrame, links: DataFrame, target: DataFrame, keys: Keys
) -> Import:
    staged, rejects = stage_payments(raw)
    associated = accounts_with_open_link(persons, links, ACCOUNT_INDEX)
    return Import(append_payments(encrypt_payments(staged, keys), associated, target, PAYMENT_INDEX), rejects)


def allocate_encrypted_payments(
    bills: DataFrame,
    payments: DataFrame,
    persons: DataFrame,
    links: DataFrame,
    cutoff: dt.date,
    block_rows: int = BLOCK_ROWS,
) -> Allocation:
    """Needs no key at all: accounts meet by their index."""
    return allocate_payments(bills, payments, persons, links, cutoff, PAYMENT_INDEX, ACCOUNT_INDEX, block_rows)


def top_encrypted_debtors(
    bills: DataFrame, units: DataFrame, links: DataFrame, persons: DataFrame, keys: Keys, **choice
) -> DataFrame:
    """`reports.top_debtors` over encrypted persons (with CONTACT_INDEX); only the winners are opened."""
    return top_debtors(
        bills, units, links, persons, **choice, contact=F.col(CONTACT_INDEX), opened=lambda p: decrypt_persons(p, keys)
    )
