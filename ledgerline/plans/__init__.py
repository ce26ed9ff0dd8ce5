"""Named query plans (the registry the entry point exposes) and bundles."""
