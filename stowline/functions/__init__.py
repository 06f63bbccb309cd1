"""Part of stowline."""
