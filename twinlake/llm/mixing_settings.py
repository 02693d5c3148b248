"""Production parameters of the source mix.  A source's domain is its number modulo 3."""

from __future__ import annotations

DOMAINS = ("web", "reference", "forum")
WEIGHTS = {"domain": {"web": 5, "reference": 4, "forum": 3}, "lang": {"en": 6, "de": 2, "fr": 2}}
BUDGET_PERCENT, EPOCHS, SEED = 75, 2, 17
