"""Where checks read from and write to."""
