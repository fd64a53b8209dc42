"""Who is oneself: identities by platform, and names."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import expr as X


@F.pandas_udf(T.StringType())
def nfc_trim(s: pd.Series) -> pd.Series:
    """Composed form, without white space at its ends.  Spark has no expression for it."""
    return s.map(lambda v: unicodedata.normalize("NFC", v).strip(), na_action="ignore")


@dataclass(frozen=True)
class Registry:
    """One's own name, aliases, and identities (platform -> as they are written).  A few entries, from configuration."""

    name: str
    aliases: tuple[str, ...] = ()
    identities: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def problems(self) -> list[str]:
        """All that is wrong with the configuration."""
        out = [f"{what} is empty or shorter than 3 characters" for what, v in (("the name", self.name), *((f"alias {a!r}", a) for a in self.aliases)) if len(v.strip()) < 3]
        return out + ["no identity is configured for any platform"] * (not any(self.identities.values()))

    def is_self(self, platform: Column, sender: Column) -> Column:
        """Whether the sender is an identity of its platform; those of other platforms don't count."""
        out = F.lit(False)
        for p, ids in self.identities.items():
            norm = F.coalesce(X.normalise_identity(nfc_trim(sender)), nfc_trim(sender)) if p == "whatsapp" else nfc_trim(sender)
            known = [F.coalesce(X.normalise_identity(F.lit(_nfc(i))), F.lit(_nfc(i))) if p == "whatsapp" else F.lit(_nfc(i)) for i in ids]
            out |= (platform == p) & F.array_contains(F.array(*known), norm) if known else F.lit(False)
        return F.coalesce(out, F.lit(False))

    def is_self_name(self, name: Column) -> Column:
        """Whether a name is one's own, an alias or an identity, in either case."""
        own = {_nfc(v).lower() for v in (self.name, *self.aliases, *(i for ids in self.identities.values() for i in ids))} - {""}
        return F.coalesce(F.lower(nfc_trim(name)).isin(*sorted(own)), F.lit(False))


def _nfc(s: str) -> str:
    return unicodedata.normalize("NFC", s).strip()


def mark_self(messages: DataFrame, me: Registry) -> DataFrame:
    return messages.withColumn("is_self", me.is_self(F.col("platform"), F.col("sender_external_id")))
