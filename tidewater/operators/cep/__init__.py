"""Complex events: patterns as data, automata that run them, the detector built on both."""
