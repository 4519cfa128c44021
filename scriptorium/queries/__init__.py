"""Registered queries of the core, by family; importing a module registers its queries."""
