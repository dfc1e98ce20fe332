"""Registered queries: DataFrame plans and the SQL that checks them."""

CORE_MODULES = ["skein.plans.corpus", "skein.plans.graph"]
