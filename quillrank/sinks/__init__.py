"""Writers for run files, feature files, data sets and id lists."""
