"""tidemerge: an offline replica of remote collections, reconciled by three-way merge, as DataFrame plans."""
