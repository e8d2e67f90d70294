"""The registered queries over the given tables, each with its SQL check where there is one."""
