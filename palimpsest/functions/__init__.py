"""Part of the text-reuse engine; see the README for the module map."""
