"""sleuthframe.streaming"""
