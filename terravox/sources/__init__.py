"""File formats, the item repository and materialised results."""
