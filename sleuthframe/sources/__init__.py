"""sleuthframe.sources"""
