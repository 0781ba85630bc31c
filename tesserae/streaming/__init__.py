"""Change capture and vote processing, in batch and as streams."""
