"""Column-level functions: identities, paths, tokens, framework tags."""
