"""The registered queries, the event view they read, and their SQL equivalents."""
