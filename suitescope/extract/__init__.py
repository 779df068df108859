"""Reading PHP test files: tokens, syntax trees, and the facts that the engine keeps of them."""
