"""Part of kelpline: plans."""
