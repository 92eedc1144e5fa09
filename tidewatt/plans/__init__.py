"""Planning over the manifest: envelopes, coverage, shards, late data, retention gates."""
