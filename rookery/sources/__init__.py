"""Sources and sinks: game files, shards, synthetic rows, literal positions."""
