"""All queries of the core, by family."""

from __future__ import annotations

from tallyforge.registry import Registry


def all_registries() -> list[Registry]:
    from tallyforge.plans import filesets, joins, ledger, problems, rules, samples, scans, stats, streams, text

    return [ledger.R, joins.R, text.R, stats.R, rules.R, problems.R, samples.R, scans.R, streams.R, filesets.R]
