"""Rule catalog: fixed values of every detector family, and their selection."""

from palisade.rules.base import LineRule, Rule, catalog_frame, registered_rules, register_rules, rules_version, select_rules

__all__ = ["LineRule", "Rule", "catalog_frame", "registered_rules", "register_rules", "rules_version", "select_rules"]
