"""Training-data operators over `documents`, `pages`, `benchmark` and `labels`; nothing outside this folder imports it."""
