"""ledgerline: multi-tenant supply-chain analytics as Spark DataFrame jobs.

Every operator is a function ``DataFrame(s) -> DataFrame`` that only builds a
logical plan; nothing calls an action except model fits. All operators work
on every tenant at once and keep ``company_id`` in every key.
"""

__version__ = "0.1.0"
